"""Ranked lexical search: terms one at a time, the rarest first, with accumulators that stop being created once no new document can win."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.llm.common import running_total, saved, slices

# Documents and postings of one block, the unit whose accumulators are held in memory.
BLOCK_DOCS, BLOCK_POSTINGS = 4_096, 500_000
# Distinct terms of the items that one pass over the documents takes; more items take more passes.
PASS_TERMS = 200_000
# Term bytes: ASCII letters (lower-cased) and digits, and all bytes of other characters; any other byte ends a term.
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _as_bytes(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(id, term, times) of all items."""
    def run(batches):
        for part in slices(batches):
            ids, terms, times = [], [], []
            for i, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for term, n in Counter(terms_of(value)).items():
                    ids.append(i)
                    terms.append(term)
                    times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["id", "term", "times"])

    return _as_bytes(items, item_id, text).mapInArrow(run, "id long, term binary, times long").groupBy("id", "term").agg(F.sum("times").alias("times"))


def _statistics(docs: DataFrame, known) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, terms of all documents, and for each known term the documents that hold it. Every task sends one row a term."""
    def run(batches):
        vocabulary, df, n_docs, n_terms = known.value, Counter(), 0, 0
        for part in slices(batches):
            for value in part.column(0).to_pylist():
                words = terms_of(value)
                n_docs += bool(words)
                n_terms += len(words)
                df.update(map(vocabulary.__getitem__, vocabulary.keys() & set(words)))
        names, counts = [-1, -2, *df], [n_docs, n_terms, *df.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(counts, pa.int64())], ["term", "n"])

    found = {r.term: r.n for r in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(-1, 0), found.pop(-2, 0), found


class Block:
    """Postings of some documents, grouped by term."""

    def __init__(self):
        self.ids, self.sizes, self.terms, self.at, self.tf = [], [], [], [], []

    def add(self, doc_id: int | None, words: list[bytes], vocabulary: dict[bytes, int]) -> None:
        counts = Counter(words)
        held = counts.keys() & vocabulary.keys()
        if held:
            self.terms += map(vocabulary.__getitem__, held)
            self.tf += map(counts.__getitem__, held)
            self.at += [len(self.ids)] * len(held)
            self.ids.append(doc_id)
            self.sizes.append(len(words))

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or len(self.terms) >= BLOCK_POSTINGS

    def postings(self, weights: dict[int, int], n_docs: int, n_terms: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each term its documents (ascending numbers in the block) and what one occurrence of it in an item adds to their scores."""
        m = np.array([75 + 25 * n * n_docs // n_terms for n in self.sizes], np.int64)
        terms, at, tf = np.array(self.terms, np.int32), np.array(self.at, np.int32), np.array(self.tf, np.int64)
        order = np.argsort(terms, kind="stable")
        terms, at, tf = terms[order], at[order], tf[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        part = 1_000_000_000 * tf // (1_000 * tf + 12 * m[at])
        return {t: (at[a:b], part[a:b] * weights[t]) for t, a, b in zip(terms[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)])}


def accumulate(query: list[tuple[int, int]], postings: dict, scores: np.ndarray, k: int, floor: int) -> int:
    """Add the scores of ``query`` ((term, times), rarest first) into ``scores`` (zeros, one a document); ``floor`` is a score that k
    documents are known to reach. Documents that can be among the best k end with their exact score. Returns the postings that were passed over.

    A document without an accumulator can gain at most the sum of what each remaining term adds anywhere in the block. Once that is below the
    kth best partial score (or ``floor``), no accumulator is created any more, and the remaining terms only update those that exist.
    """
    held = [(times, *postings[term]) for term, times in query if term in postings]
    most = [times * int(adds.max()) for times, _, adds in held]
    rest, seen, kth, passed = sum(most), 0, floor, 0
    survivors: np.ndarray | None = None
    for (times, at, adds), bound in zip(held, most):
        if survivors is None and rest < kth:
            survivors = np.flatnonzero(scores).astype(np.int32)
        if survivors is None:
            scores[at] += times * adds
            seen += bound
        elif len(survivors) * 8 < len(at):
            place = np.searchsorted(at, survivors)
            place[place == len(at)] = 0
            hit = at[place] == survivors
            scores[survivors[hit]] += times * adds[place[hit]]
            passed += len(at) - int(hit.sum())
        else:
            hit = scores[at] > 0
            scores[at[hit]] += times * adds[hit]
            passed += len(at) - int(hit.sum())
        rest -= bound
        # The kth partial score is at most ``seen``: below ``rest`` it could not stop anything yet.
        if survivors is None and rest < seen and len(scores) >= k:
            kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    return passed


class Best:
    """The best k documents of one item so far: highest score, then smallest id (null last)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def take(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        held = np.flatnonzero(scores >= max(self.floor(), 1))
        if len(held) > self.k:
            low = np.partition(scores[held], len(held) - self.k)[len(held) - self.k]
            held = held[scores[held] >= low]
        s, i, z = (np.concatenate(x) for x in ((self.scores, scores[held]), (self.ids, ids[held]), (self.null, null[held])))
        order = np.lexsort((i, z, -s))[:self.k]
        self.scores, self.ids, self.null = s[order], i[order], z[order]


def _search(docs: DataFrame, plan, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of every item."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, weights, n_docs, n_terms = plan.value
        best: dict[int, Best] = defaultdict(lambda: Best(k))

        def close(block: Block) -> None:
            if not block.ids:
                return
            postings = block.postings(weights, n_docs, n_terms)
            null = np.array([i is None for i in block.ids])
            ids = np.array([i or 0 for i in block.ids], np.int64)
            scores = np.zeros(len(ids), np.int64)
            for item, query in enumerate(queries):
                scores[:] = 0
                accumulate(query, postings, scores, k, best[item].floor() if item in best else 0)
                if scores.any():
                    best[item].take(scores, ids, null)

        block = Block()
        for part in slices(batches):
            for doc_id, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                block.add(doc_id, terms_of(value), vocabulary)
                if block.full():
                    close(block)
                    block = Block()
        close(block)
        for item, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), item, np.int32)), pa.array(b.ids, mask=b.null), pa.array(b.scores)], ["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Terms, weights and scores are those of the query's contract; equal scores go by ascending doc_id, null last. Whole texts are read. Null and
    empty texts have no terms; an item without a term in any document has no rows. Rows of one item_id (null is one) are one item, whose terms
    add up. Rows of ``docs`` are ranked each for itself, so repeated ones follow each other. Empty tables give no rows; other columns are not read.

    The documents are scanned twice: for the statistics of the items' terms, then block by block. A block of documents is inverted in
    memory and its items are scored by ``accumulate``; the best k so far of the task are the next block's floor. Only k rows an item and
    task are shuffled. Items beyond ``pass_terms`` terms are taken in several passes; one item's terms must fit into a task.
    """
    wanted = saved(_item_terms(items, item_id, item_text), "item-terms")
    sizes = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("terms"))
    passes = saved(running_total(sizes, ["id"], "terms", "before").select("id", F.floor(F.col("before") / pass_terms).alias("pass")), "passes")
    last = passes.agg(F.max("pass")).first()[0]
    source, spark, found = _as_bytes(docs, doc_id, text), docs.sparkSession, []
    for turn in range(-1 if last is None else last + 1):
        turns = passes.where(F.col("pass") == turn).select(F.col("id").alias("_id"))
        rows = wanted.join(turns, F.col("id").eqNullSafe(F.col("_id"))).select("id", "term", "times").collect()
        vocabulary = {t: n for n, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        known = spark.sparkContext.broadcast(vocabulary)
        n_docs, n_terms, df = _statistics(source, known)
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        queries: dict[int | None, list] = defaultdict(list)
        for r in rows:
            if (t := vocabulary[bytes(r.term)]) in weights:
                queries[r.id].append((t, r.times))
        names = sorted(queries, key=lambda i: (i is None, i or 0))
        plan = spark.sparkContext.broadcast((vocabulary, [sorted(queries[i], key=lambda q: (df[q[0]], q[0])) for i in names], weights, n_docs, n_terms))
        best = _search(source, plan, k).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
        named = spark.createDataFrame([(n, i) for n, i in enumerate(names)], "item int, item_id long")
        found.append(best.where(F.col("rank") <= k).join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
