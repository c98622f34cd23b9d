"""A corpus pipeline: quality filter, exact dedup, near dedup, mixing to source weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm import bpe, exact_dedup, factor_machine, jaccard_join, mixing
from shelfsense.llm.common import saved
from shelfsense.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; nulls and empty texts are scored as empty texts."""
    machine = factor_machine.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return factor_machine.keep_quality(docs, machine)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at a similarity of 0.8 join, the one with the smallest doc_id stays."""
    return jaccard_join.keep_one_each(docs, n=5, num=8, den=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or the parts of them, that each round of the mix takes; a doc_id can come more than once."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers) and the hash of the text they decode to."""
    encoded = bpe.encode_documents(docs, vocabulary_path())
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

# The classifier, the draw of blocks and byte-pair merging have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
