"""Repeated runs of lines: a suffix array over line numbers by distributed prefix doubling, whose common-prefix intervals show copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import BROADCAST_BYTES, bloom_filter, bloom_hits, map_texts, running_total, salted_join, saved, slices

# A run of lines counts as a copy from this many words on.
MIN_WORDS = 10


def _lines(texts: list[bytes], min_words: int) -> dict:
    """Per text: its number of lines; number in the text, hash, least run and least run back of each line with words. The least run of a line
    is how many such lines from it on have ``min_words`` words together, the least run back how many up to it; 0 where the text ends before,
    and back also where the same lines are the least run of their first."""
    out = {"n_lines": [], "at": [], "line": [], "run": [], "back": []}
    for text in texts:
        lines = text.split(b"\n")
        words = [len(x.split()) for x in lines]
        at = np.flatnonzero(words)
        running = np.concatenate([[0], np.cumsum(np.array(words, np.int64)[at])])
        run = np.searchsorted(running, running[:-1] + min_words) - np.arange(len(at))
        run[running[:-1] + min_words > running[-1]] = 0
        first = np.searchsorted(running, running[1:] - min_words, "right") - 1
        back = np.where(first < 0, 0, np.arange(1, len(at) + 1) - first)
        back[run[first] == back] = 0
        out["n_lines"].append(len(lines) if text else 0)
        out["at"].append(at.tolist())
        out["line"].append([xxhash.xxh3_64_intdigest(lines[i].strip()) - (1 << 63) for i in at])
        out["run"].append(run.tolist())
        out["back"].append(back.tolist())
    return {"n_lines": pa.array(out["n_lines"], pa.int32()), "at": pa.array(out["at"], pa.list_(pa.int32())),
            "line": pa.array(out["line"], pa.list_(pa.int64())), "run": pa.array(out["run"], pa.list_(pa.int32())),
            "back": pa.array(out["back"], pa.list_(pa.int32()))}


def _ranked(suffixes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``suffixes`` with ``rank``: how many suffixes come before all with the same ``keys``. Equal keys are counted before they are
    ordered, so the most frequent line costs one row a task."""
    groups = saved(suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "groups")
    ranks = running_total(groups, keys, "_n", "rank").withColumn("_key", F.struct(*keys)).select("_key", "_n", "rank")
    return salted_join(suffixes.withColumn("_key", F.struct(*keys)), ranks, "_key", "_n", F.struct("row", "seq"), total).drop("_key", "_n", *keys)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text",
                   broadcast_bytes: int = BROADCAST_BYTES, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, removed (ascending numbers from 0 of the lines that are later copies), runs (how
    many stretches of neighbouring lines with words they make; maximal runs that touch or overlap are one stretch).

    Lines are compared without white space at their ends; lines without words are passed over and never removed. A line is removed when
    it lies in a run of lines with at least ``min_words`` words together that occurs earlier, in the order of doc_id (null first), row
    and line; copies may lie in one text and overlap. A null text has no lines; of repeated rows the first keeps its lines; an empty
    table gives no rows; other columns are not read. Lines are compared by 64-bit hash.

    That holds with ``whole``. Without it only the least runs from each line on are compared, and the last lines of a copied passage stay
    where they have less than ``min_words`` words together.

    Only suffixes that begin with a repeated line are ordered. Doubling gives rank_k, the place of a suffix by its
    first 2^k lines, until 2^k reaches the longest least run. Suffixes with equal rank_k at their start and at run - 2^k form the
    common-prefix interval of that depth; all of it but its first suffix are later copies. A line of a maximal run begins a least run that
    lies in it, or less than ``min_words`` words follow in it and the least run back from its last line holds the line: together the least
    runs, and with ``whole`` those back, are the maximal runs.
    """
    found = map_texts(docs, doc_id, text, "n_lines int, at array<int>, line array<long>, run array<int>, back array<int>", lambda: lambda t: _lines(t, min_words))
    scanned = saved(found.withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = scanned.select("doc_id", "row", F.posexplode(F.arrays_zip("line", "run", "back")).alias("seq", "_l")).select(
        "doc_id", "row", "seq", F.col("_l.line").alias("line"), F.col("_l.run").alias("run"), F.col("_l.back").alias("back"))
    repeated = saved(lines.groupBy("line").count().where("count > 1").select("line"), "repeated")
    known = repeated.count()
    hits = bloom_hits(lines, F.col("line"), bloom_filter(repeated, F.col("line"), known), known, "maybe", broadcast_bytes).where("maybe").drop("maybe")
    suffixes = saved(hits, "suffixes")
    total = suffixes.count()
    longest = suffixes.agg(F.max(F.greatest("run", "back") if whole else F.col("run"))).first()[0] or 0

    level = saved(_ranked(suffixes.select("row", "seq", "line"), ["line"], total), "rank")
    windows = suffixes.where("run > 0").select("doc_id", "row", "seq", "run")
    if whole:
        windows = windows.unionByName(suffixes.where("back > 0").select("doc_id", "row", (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("run")))
    keyed, depth = None, 1
    while depth <= max(longest, 1):
        # Runs of depth to 2 * depth - 1 lines: two stretches of ``depth`` lines cover them.
        of = windows.where(F.col("run").between(depth, 2 * depth - 1)).join(level.withColumnRenamed("rank", "head"), ["row", "seq"])
        tails = level.select("row", F.col("seq").alias("_tail"), F.col("rank").alias("tail"))
        of = of.withColumn("_tail", F.col("seq") + F.col("run") - depth).join(tails, ["row", "_tail"]).drop("_tail")
        keyed = of if keyed is None else keyed.unionByName(of)
        if 2 * depth > longest:
            break
        second = level.select("row", (F.col("seq") - depth).alias("seq"), F.col("rank").alias("second"))
        level = saved(_ranked(level.withColumnRenamed("rank", "first").join(second, ["row", "seq"]), ["first", "second"], total), "rank")
        depth *= 2

    keyed = saved(keyed.withColumn("interval", F.struct("run", "head", "tail")).drop("head", "tail"), "keyed")
    place = F.struct("doc_id", "row", "seq")
    intervals = keyed.groupBy("interval").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = salted_join(keyed, intervals, "interval", "_n", F.struct("row", "seq"), total).where(place > F.col("first"))
    marked = later.select("row", F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("run") - 1)).alias("seq")).distinct()
    by_row = marked.groupBy("row").agg(F.array_sort(F.collect_list("seq")).alias("_seqs"))
    seqs = F.coalesce("_seqs", F.array().cast("array<int>"))
    starts = F.filter(seqs, lambda x, i: (i == 0) | (F.get(seqs, i - 1) < x - 1))
    return scanned.select("doc_id", "row", "n_lines", "at").join(by_row, "row", "left").select(
        "doc_id", "n_lines", F.transform(seqs, lambda x: F.get("at", x)).alias("removed"), F.size(starts).alias("runs"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with the text of ``repeated_lines``' removed lines cut out and its length in ``n_chars`` where there is
    such a column. Rows are written once with a number of their own, by which the lines to remove come back. Columns may have any names."""
    columns, at_text = docs.columns, docs.columns.index(text)
    packed = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    keys = packed.select(F.struct(F.col("doc").getField(doc_id).alias("id"), "row").alias("doc_id"), F.col("doc").getField(text).alias("text"))
    removed = repeated_lines(keys, min_words, whole=True).where("size(removed) > 0").select(F.col("doc_id.row").alias("row"), "removed")

    def run(batches):
        for part in slices(batches):
            doc = part.column(0)
            arrays = doc.flatten()
            texts = []
            for value, cut in zip(arrays[at_text].to_pylist(), part.column(1).to_pylist()):
                gone = set(cut or ())
                texts.append("\n".join(x for i, x in enumerate(value.split("\n")) if i not in gone) if gone else value)
            arrays[at_text] = pa.array(texts, arrays[at_text].type)
            if n_chars in columns:
                i = columns.index(n_chars)
                arrays[i] = pa.array([old if not cut else len(t) for old, cut, t in zip(arrays[i].to_pylist(), part.column(1).to_pylist(), texts)], arrays[i].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return packed.join(removed, "row", "left").select("doc", "removed").mapInArrow(run, docs.schema)
