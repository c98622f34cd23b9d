"""Mixing sources to target weights: words packed into fixed-length blocks, drawn per output shard through index permutations."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.llm.common import fresh, map_texts, running_total, salted_join, saved, scratch, slices

WEIGHTS = (1, 2, 3)
# A source is used at most so many times.
REPEATS = 3
BLOCK_WORDS = 128
SHARD_BLOCKS = 4_096
# Shards are drawn in two steps of at most about so many each.
TIER_SHARDS = 1_024
# Slots that one task expands, as long as there are enough tasks.
TASK_SLOTS = 50_000
SEED = 20


# Pseudorandom permutations of 0..n-1 ------------------------------------------------------------------

def _rounds(seed: int, source: int, epoch: int) -> list[np.uint64]:
    digest = hashlib.blake2b(f"{seed}|{source}|{epoch}".encode(), digest_size=32).digest()
    return list(np.frombuffer(digest, "<u8"))


def _stir(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (half + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & mask


def permute(at: np.ndarray, n: int, seed: int, source: int, epoch: int, back: bool = False) -> np.ndarray:
    """Where a Feistel network over the smallest even number of bits, walked until it falls below ``n``, sends each index;
    ``back`` gives the inverse."""
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = _rounds(seed, source, epoch)
    out = at.astype(np.uint64)
    left = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(left):
            high, low = out[left] >> shift, out[left] & mask
            for key in reversed(keys) if back else keys:
                high, low = (low ^ _stir(high, key, mask), high) if back else (low, high ^ _stir(low, key, mask))
            out[left] = (high << shift) | low
            left = left[out[left] >= n]
    return out.astype(np.int64)


# Plan of the sources ----------------------------------------------------------------------------------

def count_words(docs: DataFrame, doc_id: str, text: str, source: str, row: str | None = None) -> DataFrame:
    """doc_id, source, size (words of the whole text) and row, a number that no other row has: the given column, or a new one."""
    sized = map_texts(docs, doc_id, text, "size long", lambda: lambda texts: {"size": [len(t.split()) for t in texts]},
                      {"source": source} | ({"row": row} if row else {}))
    return saved(sized if row else sized.withColumn("row", F.monotonically_increasing_id()), "sizes")


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: source, idx (place by code point, null last), docs, source_size, target, blocks, quota.

    Targets share all words by weight; one above ``repeats`` times its source stops there and the rest is shared again until
    none is above. ``quota`` is the number of blocks drawn that comes nearest the target; at most ``repeats`` times all blocks.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = totals.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    placed = running_total(ordered, ["_null", "source"], "_one", "idx").drop("_null", "_one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    plan = saved(placed.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * F.lit(float(repeats))), "sources")
    # The level by which weights are multiplied only rises, and each round caps at least one more source or is the last.
    level = 0.0
    while True:
        full = F.col("_most") <= F.col("_weight") * level
        row = plan.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("_most"))).alias("capped"), F.sum(F.when(~full, F.col("_weight"))).alias("open")).first()
        new = ((row["all"] or 0) - (row["capped"] or 0)) / row["open"] if row["open"] else float("inf")
        if new <= level or not row["open"]:
            break
        level = new
    target = F.least(F.col("_most"), F.col("_weight") * level) if level else F.lit(0.0)
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    whole = F.floor(F.col("target") / F.col("source_size"))
    quota = whole * F.col("blocks") + F.round((F.col("target") - whole * F.col("source_size")) * F.col("blocks") / F.col("source_size"))
    return plan.withColumn("target", target).withColumn("blocks", blocks).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(quota, repeats * F.col("blocks"))).otherwise(0).cast("bigint")).drop("_weight", "_most")


# Draws ------------------------------------------------------------------------------------------------

def _spread(counts: DataFrame, parts: int, seed: int, out: str) -> DataFrame:
    """Multinomial counts of each row's ``n`` over ``parts`` equal parts: (idx, place, n) with place = place * parts + part."""

    def run(batches):
        for part in slices(batches, 64):
            columns = [[], [], []]
            for idx, place, n in zip(*(c.to_pylist() for c in part.columns)):
                drawn = np.random.default_rng([seed, idx, place, parts]).multinomial(n, np.full(parts, 1 / parts))
                some = np.flatnonzero(drawn)
                for column, values in zip(columns, (np.full(len(some), idx), place * parts + some, drawn[some])):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], ["idx", out, "n"])

    return counts.select("idx", "place", "n").mapInArrow(run, f"idx long, {out} long, n long")


def draw_slots(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(idx, shard, slot, block): which block of its source each slot of each output shard takes.

    Each source's quota falls on the shards by a multinomial draw, so a shard's source counts are multinomial and a source's sum to its
    quota. A source's slots are numbered through; slot j takes block permutation(j mod blocks) of round j div blocks.
    """
    quota = plan.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-quota // shard_blocks))
    tiers = -(-shards // TIER_SHARDS)
    first = plan.where("quota > 0").select("idx", F.lit(0).cast("bigint").alias("place"), F.col("quota").alias("n"))
    if tiers > 1:
        first = _spread(first, tiers, seed, "place")
    counts = saved(_spread(first, -(-shards // tiers), seed, "shard"), "shards")
    starts = running_total(counts, ["shard"], "n", "start", ["idx"]).join(plan.select("idx", "blocks"), "idx")
    tasks = min(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + quota // TASK_SLOTS)

    def run(batches):
        for part in slices(batches, 16):
            for idx, shard, n, start, blocks in zip(*(c.to_pylist() for c in part.columns)):
                slots = np.arange(start, start + n)
                rounds = slots // blocks
                taken = np.concatenate([permute(slots[rounds == r] % blocks, blocks, seed, idx, int(r)) for r in np.unique(rounds)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, idx)), pa.array(np.full(n, shard)), pa.array(slots), pa.array(taken)],
                                                 ["idx", "shard", "slot", "block"])

    return starts.select("idx", "shard", "n", "start", "blocks").repartition(tasks, "idx", "shard").mapInArrow(run, "idx long, shard long, slot long, block long")


def drawn_words(sizes: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """What each drawn slot takes of each document: row, doc_id, source, size, source_size, target, idx, shard, slot, low, high (the words from
    ``low`` to before ``high`` of the document). A document keeps one row for each of its blocks that no slot takes, with a null slot.

    The words of a source, in the order of doc_id (null first) and row, are cut into blocks; blocks meet the drawn slots in a join on
    source and block. A block has at most as many documents as words, and as many slots as rounds.
    """
    label = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    named = salted_join(sizes.withColumn("label", label).drop("source"), plan.withColumn("label", label), "label", "docs", F.col("row"), sizes.count())
    placed = running_total(named.select("doc_id", "row", "source", "idx", "size", "source_size", "target"), ["doc_id", "row"], "size", "start", ["idx"])
    end = F.col("start") + F.col("size")
    spans = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))))
    low, high = F.greatest(F.col("start"), F.col("block") * block_words), F.least(end, (F.col("block") + 1) * block_words)
    spans = spans.withColumn("low", low - F.col("start")).withColumn("high", high - F.col("start")).drop("start")
    # A few rows of counts become all slots: the planner, which sees the counts, would broadcast them.
    return spans.join(draw_slots(plan, shard_blocks, seed).hint("merge"), ["idx", "block"], "left").drop("block")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words of it that the drawn slots take).

    A null text has no words; null is a source of its own, placed last; repeated rows count as often as they occur; an empty table gives
    no rows; other columns are not read.
    """
    sizes = count_words(docs, doc_id, text, source)
    plan = saved(source_plan(sizes, weights, repeats, block_words), "plan")
    words = F.when(F.col("slot").isNotNull(), F.col("high") - F.col("low"))
    return (drawn_words(sizes, plan, block_words, shard_blocks, seed).groupBy("row", "doc_id", "source", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken")).drop("row"))


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
                 shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                 n_chars: str = "n_chars", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The output shards: all columns of ``docs``, then ``shard`` and ``slot`` (under other names where ``docs`` has such columns).

    A row is the part of a document that lies in the block which a slot of a shard takes, with its length in ``n_chars`` where there is
    such a column; what a slot takes of several documents are several rows. Slots are numbered by source. A document without words, or
    with none taken, has no row. Places and slots are found without the texts, which then move once.
    """
    columns, at_text = docs.columns, docs.columns.index(text)
    packed = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    with scratch(docs.sparkSession) as keep:
        fields = packed.select(*[F.col("doc").getField(c).alias(name) for c, name in ((doc_id, "doc_id"), (text, "text"), (source, "source"))], "row")
        sizes = count_words(fields, "doc_id", "text", "source", "row")
        plan = saved(source_plan(sizes, weights, repeats, block_words), "plan")
        drawn = drawn_words(sizes, plan, block_words, shard_blocks, seed).where("slot IS NOT NULL")
        parts = keep(saved(drawn.groupBy("row").agg(F.collect_list(F.struct("shard", "slot", "low", "high")).alias("parts")), "parts"))
    shard, slot = fresh(docs, shard), fresh(docs, slot)

    def run(batches):
        for part in slices(batches, 64):
            doc, rows, taken, places = part.column(0), [], [], []
            for i, (whole, spans) in enumerate(zip(doc.field(at_text).to_pylist(), part.column(1).to_pylist())):
                rows += [i] * len(spans)
                taken += cut_words(whole, [(p["low"], p["high"]) for p in spans])
                places += [(p["shard"], p["slot"]) for p in spans]
            # Not the whole text for each of its parts: that is the square of a text's length.
            arrays = [pa.array(taken, c.type) if i == at_text else c.take(pa.array(rows, pa.int64())) for i, c in enumerate(doc.flatten())]
            if n_chars in columns:
                arrays[columns.index(n_chars)] = pa.array([len(t) for t in taken], pa.int64()).cast(arrays[columns.index(n_chars)].type)
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([p[k] for p in places], pa.int64()) for k in (0, 1))], [*columns, shard, slot])

    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.LongType()), T.StructField(slot, T.LongType())])
    return packed.join(parts, "row").select("doc", "parts").mapInArrow(run, schema)


def mixed_documents(docs: DataFrame, *args, **options) -> DataFrame:
    """The rows of ``mixed_blocks`` with the columns of ``docs`` alone."""
    return mixed_blocks(docs, *args, **options).select(*[f"`{c}`" for c in docs.columns])


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """For each half-open span of words, that part of ``text``: from its first word to its last, the whole text where these are all words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    return [text if (low, high) == (0, len(places)) else raw[places[low][0]:places[high - 1][1]].decode() for low, high in spans]
