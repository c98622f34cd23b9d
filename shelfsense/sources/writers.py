"""Sinks. Spark's commit protocol publishes a folder only when the whole job succeeded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.plans.groups import scalar_columns
from shelfsense.schemas import cast_to


def write_parquet(df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "overwrite", partition_by=()) -> None:
    """Typed, zstd-compressed Parquet; an empty frame still leaves its schema behind."""
    out = cast_to(df, schema) if schema is not None else df
    writer = out.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """The scalar columns as CSV."""
    write_csv(scalar_columns(df), path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8, NULL fields written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def append_records(records: DataFrame, errors: DataFrame, path: str, errors_path: str) -> None:
    """Finished records and errors to their own append-only files."""
    write_jsonl(records, path, "append")
    write_jsonl(errors, errors_path, "append")


def write_splits(df: DataFrame, path: str, column: str = "split", fmt: str = "parquet") -> None:
    """One folder per split, written in one pass."""
    df.write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def write_phase1(parts: DataFrame, path: str) -> None:
    """``split=train``, ``val`` and ``test``, written once; train_val is the first two folders (``read_train_val``)."""
    write_splits(parts, path)


def read_train_val(spark: SparkSession, path: str) -> DataFrame:
    """The rows of train and val, as the folds take them: only their two folders are read."""
    return spark.read.parquet(path).where("split IN ('train', 'val')")


def write_folds(df: DataFrame, path: str) -> None:
    """``fold=i`` holds the validation rows of fold i; its training rows are all other folders."""
    write_splits(df, path, "fold")


def write_chat_splits(df: DataFrame, path: str) -> None:
    """Messages only, as JSON lines per split."""
    write_splits(df.select("split", "messages"), path, "split", "json")


def write_insight_documents(documents: DataFrame, path: str) -> None:
    """File name and JSON text per product; many products share a file, unlike one small file each."""
    documents.select(F.col("file_name"), F.col("document")).write.mode("overwrite").option("compression", "zstd").parquet(path)
