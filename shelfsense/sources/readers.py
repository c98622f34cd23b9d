"""Scans: JSON lines, CSV, Parquet; always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.schemas import SOURCE_META_JSON, SOURCE_REVIEWS_JSON, struct_of


def read_jsonl(spark: SparkSession, path, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """One object per line. A malformed line, or one that is no object, fails the job, or is skipped when ``tolerant``. Blank lines are passed over."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    is_object = F.col("value").rlike(r"^\s*\{")
    if tolerant:
        parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        return lines.where(is_object).select(parsed.alias("_row")).where("_row._broken IS NULL").select(*[F.col("_row").getField(c).alias(c) for c in schema.names])
    # A filter of the reader may be checked before the blank lines are gone.
    checked = F.when(is_object | (F.trim("value") == ""), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a line that is no JSON object: "), F.substring("value", 1, 100))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("_row")).select("_row.*")


def read_source_reviews(spark: SparkSession, path) -> DataFrame:
    return read_jsonl(spark, path, SOURCE_REVIEWS_JSON)


def read_source_meta(spark: SparkSession, path) -> DataFrame:
    return read_jsonl(spark, path, SOURCE_META_JSON)


def read_csv(spark: SparkSession, path, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and quoted texts that may span lines; ``columns`` reads only those."""
    df = (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    )
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By suffix: .parquet or .csv (which needs a schema); anything else is an error."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return read_csv(spark, path, schema)
    raise ValueError(f"unsupported input file format: {path}")


def finished_keys(spark: SparkSession, path) -> DataFrame:
    """(product, sentiment) pairs of an output file; unreadable lines are skipped."""
    schema = struct_of("product_id string, sentiment string")
    return read_jsonl(spark, path, schema, tolerant=True).select("product_id", "sentiment").distinct()


def sample_is_complete(spark: SparkSession, path, schema: T.StructType, n: int, key: str = "product_id"):
    """Whether an existing CSV sample holds exactly ``n`` rows, with its distinct ids when it does."""
    ids = read_csv(spark, path, schema, [key])
    if ids.count() != n:
        return None
    return ids.where(F.trim(F.col(key)) != "").distinct()
