"""Serving tables on plain Parquet: insert what is absent, upsert by snapshot or by bucket."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.ids import load_review_id
from shelfsense.functions.text import strip
from shelfsense.operators.dedupe import keep_first
from shelfsense.schemas import column_or


def absent_rows(batch: DataFrame, target: DataFrame | None, key: str, order: list) -> DataFrame:
    """The first row per key of the batch whose key the target does not hold."""
    first = keep_first(batch, [key], order)
    return first if target is None else first.join(target.select(key), key, "left_anti")


def insert_absent(batch: DataFrame, spark: SparkSession, path: str, key: str, order: list) -> None:
    """Append rows with new keys; a repeated load changes nothing."""
    target = spark.read.parquet(path) if table_exists(spark, path) else None
    absent_rows(batch, target, key, order).write.mode("append").parquet(path)


def loadable_reviews(reviews: DataFrame, products: DataFrame, ordinal: str) -> DataFrame:
    """Reviews with text of loaded products, with an id made from content where none is given."""
    kept = reviews.where((strip(F.col("product_id")) != "") & (strip(F.col("review_text")) != ""))
    given = column_or(reviews, "review_id", F.lit(None).cast("string"))
    return kept.join(products.select("product_id"), "product_id", "left_semi").withColumn(
        "review_id", load_review_id(given, F.col("product_id"), F.col(ordinal), F.col("review_text"))
    )


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return bool(fs.exists(where))


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Finished snapshots of a table, oldest first."""
    fs, where = _files(spark, root)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if n.startswith("snapshot-") and table_exists(spark, f"{root}/{n}/_SUCCESS")]
    return [f"{root}/{n}" for n in sorted(done)]


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest finished snapshot; an empty frame of ``schema`` (or None) when there is none."""
    found = snapshots(spark, root)
    if found:
        return spark.read.parquet(found[-1])
    return spark.createDataFrame([], schema) if schema is not None else None


def _snapshot_path(root: str, number: int) -> str:
    return f"{root}/snapshot-{number:020d}"


def write_snapshot(df: DataFrame, root: str, version: int | None = None) -> str:
    """A new snapshot beside the old ones, so the input may read the previous one. Writing the same
    version again replaces it, which makes a repeated batch harmless."""
    path = _snapshot_path(root, version if version is not None else int(time.time() * 1000))
    df.write.mode("overwrite").parquet(path)
    return path


# Tables laid out by a hash bucket of their key: a write replaces the buckets it touches, the others keep their files.

# Buckets of a table whose maker names no number, and the rows of a bucket that one task writes.
BUCKETS = 64
SLICE_ROWS = 5_000_000


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_buckets(spark: SparkSession, root: str, buckets: int) -> int:
    """Fix the number of buckets of a new table; of one that exists, its number stays. Many buckets keep what a small batch rewrites small."""
    if buckets < 1:
        raise ValueError("a table needs a bucket")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("ignore").json(f"{root}/layout")
    return table_buckets(spark, root)


def table_buckets(spark: SparkSession, root: str) -> int:
    """The number of buckets the table was made with."""
    return spark.read.schema("buckets int").json(f"{root}/layout").first()[0] if table_exists(spark, f"{root}/layout") else BUCKETS


def touched_buckets(df: DataFrame, root: str, key: str) -> list[int]:
    """The buckets that the keys of ``df`` fall into, at most all of the table's."""
    return sorted(r[0] for r in df.select(bucket_of(key, table_buckets(df.sparkSession, root))).distinct().collect())


def current_buckets(spark: SparkSession, root: str, before: int | None = None) -> dict[int, str]:
    """The newest finished folder of each bucket, of versions below ``before``. Lists folders, reads no data."""
    newest: dict[int, str] = {}
    for path in snapshots(spark, root):
        if before is not None and path >= _snapshot_path(root, before):
            continue
        fs, where = _files(spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        newest |= {int(n.removeprefix("_bucket=")): f"{path}/{n}" for n in names if n.startswith("_bucket=")}
    return newest


def read_buckets(spark: SparkSession, root: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The table, or only the named buckets of it; None when there is nothing."""
    found = current_buckets(spark, root, before)
    paths = [p for b, p in sorted(found.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def read_versions(spark: SparkSession, root: str, buckets: list[int], upto: int) -> DataFrame | None:
    """The rows of the named buckets in all versions up to ``upto``, for tables to which every version adds."""
    paths, wanted = [], {f"_bucket={b}" for b in buckets}
    for path in snapshots(spark, root):
        if path <= _snapshot_path(root, upto):
            fs, where = _files(spark, path)
            paths += [f"{path}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(where)) if n in wanted]
    return spark.read.parquet(*paths) if paths else None


def write_buckets(df: DataFrame, root: str, key: str, version: int, slices: int = 1) -> str:
    """All rows of the buckets that occur in ``df``, as a new version of just these. The same version again replaces itself. ``slices`` deals each
    bucket over so many tasks and files by a second hash of the whole row, so a bucket of any size, or of one hot key, is no single task's."""
    path = _snapshot_path(root, version)
    spread = df.withColumn("_bucket", bucket_of(key, table_buckets(df.sparkSession, root)))
    if slices > 1:
        dealt = spread.withColumn("_slice", F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(slices)))
        spread = dealt.repartition("_bucket", "_slice").drop("_slice")
    else:
        spread = spread.repartition("_bucket")
    spread.write.mode("overwrite").partitionBy("_bucket").parquet(path)
    return path


def drop_superseded(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Delete bucket folders that a newer version replaces, but for the last ``keep`` versions; gives what went."""
    held, gone = set(current_buckets(spark, root).values()), []
    for path in snapshots(spark, root)[:-keep]:
        fs, where = _files(spark, path)
        for status in fs.listStatus(where):
            bucket = f"{path}/{status.getPath().getName()}"
            if "/_bucket=" in bucket and bucket not in held:
                fs.delete(status.getPath(), True)
                gone.append(bucket)
    return gone
