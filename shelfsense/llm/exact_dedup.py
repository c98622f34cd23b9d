"""Exact duplicates by two passes over a Bloom filter of repeated hashes: only possibly repeated rows are shuffled."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import BROADCAST_BYTES, bloom_filter, bloom_hits, bloom_place, map_texts, salted_join, saved, scratch, slices


def _digests(texts: list[bytes]) -> dict:
    return {"sha": [hashlib.sha256(t.lower()).digest() for t in texts]}  # bytes.lower changes A-Z only


def text_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sha (SHA-256 of the whole text, A-Z lower-cased, null as empty) and row, a number that no other row has."""
    hashed = map_texts(docs, doc_id, text, "sha binary", lambda: _digests)
    return saved(hashed.withColumn("row", F.monotonically_increasing_id()), "hashes")


def repeated_slots(hashes: DataFrame, keys: int) -> DataFrame:
    """First pass: the filter's bits that at least two rows set, (block, bits). Counts merge in every task before the shuffle, so
    many copies of one text stay one record a task."""
    block, first, second = bloom_place(F.col("sha"), keys)
    bits = hashes.select(block.alias("_block"), F.explode(F.array(first, second)).alias("_bit")).groupBy("_block", "_bit").count()
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))
    return bits.where("count > 1").groupBy("_block").agg(F.bit_or(one).alias("_bits"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest doc_id stays; a null doc_id is smaller than
    any other, and of rows that share text and doc_id exactly one stays. A null text is an empty one. An empty table gives no
    rows; other columns are not read. Texts are read once; the two passes run over their hashes.
    """
    hashes = text_hashes(docs, doc_id, text)
    total = hashes.count()
    marked = bloom_hits(hashes, F.col("sha"), repeated_slots(hashes, total), total, "_maybe", broadcast_bytes)
    alone = marked.where("NOT _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                             F.lit(True).alias("kept"), "sha")
    maybe = marked.where("_maybe").drop("_maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    settled = salted_join(maybe, groups, "sha", "group_size", F.col("row"), total).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("_best.row")).alias("kept"), "sha")
    return alone.unionByName(settled).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs``, all columns, without the rows that ``exact_duplicates`` does not keep.

    Rows whose id the filter of repeated groups does not hold, nearly all, pass straight through; only the others carry their
    text through a shuffle and are compared by hash. Of rows that share text and doc_id one stays. Columns may have any names.
    """
    with scratch(docs.sparkSession) as keep:
        groups = keep(saved(exact_duplicates(docs, doc_id, text, broadcast_bytes).where("group_size > 1"), "repeated"))
    total = groups.count()
    ids = bloom_filter(groups.where("doc_id IS NOT NULL"), F.col("doc_id"), total)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(doc_id).alias("id"))
    marked = bloom_hits(packed, F.col("id"), ids, total, "_maybe", broadcast_bytes)
    straight = marked.where("NOT _maybe AND id IS NOT NULL").select("doc.*")

    def hashed(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_digests(part.column(2).to_pylist())["sha"])], ["doc", "id", "sha"])

    inner = F.coalesce(F.col("doc").getField(text), F.lit("")).cast("binary")
    others = marked.where("_maybe OR id IS NULL").select("doc", "id", inner.alias("text"))
    others = others.mapInArrow(hashed, others.drop("text").schema.add("sha", "binary"))
    winners = groups.where("kept").select(F.unhex("text_sha256").alias("sha"), F.col("keep_id").alias("best"), "group_size")
    joined = salted_join(others, winners, "sha", "group_size", F.col("id"), total, "left")
    unique = joined.where("group_size IS NULL")
    stay = joined.where("group_size IS NOT NULL AND id <=> best").dropDuplicates(["sha"])
    return straight.unionByName(unique.select("doc.*")).unionByName(stay.select("doc.*"))
