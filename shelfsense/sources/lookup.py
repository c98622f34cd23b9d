"""Parquet tables that are read by key or by page without a scan: ordered files, key filters in their footers, and a directory of what lies where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of one Parquet page and of one mark of the page directory: the least that a lookup reads.
STEP = 1_000
# So many keys at most are pushed into a scan as a list; more are joined.
LISTED_KEYS = 1_000
# Rows of a file that a table's directory assumes where the caller does not say.
FILE_ROWS = 5_000_000


def write_lookup(df: DataFrame, root: str, key: str, number: str | None = None, distinct_keys: int = FILE_ROWS, step: int = STEP, files: int | None = None) -> None:
    """Write ``df`` ordered by ``key`` for lookups: ``root/data``, ``root/files`` and ``root/marks``.

    Rows are range-partitioned and sorted, so a key lies in one file and in neighbouring pages of it; each row group carries a Bloom filter
    of its keys (sized for ``distinct_keys``) and each page its least and largest key. ``files`` lists every file with its key range and first row
    number, ``marks`` the key of every ``step``-th row of a file. ``number`` names a column to add: unique longs, ascending in the
    order of the table, with gaps. Rows with a null key come first. Both directories come from one narrow read of what was written.
    """
    spark = df.sparkSession
    ordered = (df.repartitionByRange(files, key) if files else df.repartitionByRange(key)).sortWithinPartitions(key)
    if number:
        ordered = ordered.withColumn(number, F.monotonically_increasing_id())
    writer = ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", step)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct_keys).parquet(f"{root}/data")
    rows = spark.read.parquet(f"{root}/data").select(F.col(key).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    held = rows.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"), F.count("key").alias("keyed"))
    # One row a file: the window runs over the list of files.
    before = W.orderBy(F.asc_nulls_first("low"), "file").rowsBetween(W.unboundedPreceding, -1)
    held.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{root}/files")
    # The number of rows with smaller keys in the file: where a read from the mark's key on begins.
    marks = rows.where(F.col("at") % step == 0)
    least = rows.join(marks.select("file", "key").distinct(), ["file", "key"]).groupBy("file", "key").agg(F.min("at").alias("from"))
    marks.join(least, ["file", "key"], "left").select("file", "at", "key", F.coalesce("from", F.lit(0)).alias("from")).repartitionByRange("file", "at").sortWithinPartitions(
        "file", "at").write.mode("overwrite").parquet(f"{root}/marks")


def read_all(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data")


def _files_of(spark: SparkSession, root: str, wanted: Column) -> list[str]:
    """Paths of the files whose directory row meets ``wanted``, in the order of the table."""
    return [f"{root}/data/{r.file}" for r in spark.read.parquet(f"{root}/files").where(wanted).orderBy("first").select("file").collect()]


def read_keys(spark: SparkSession, root: str, key: str, keys: list) -> DataFrame:
    """The rows with one of ``keys`` (a bounded list, at most ``LISTED_KEYS``): only files whose range holds a key are opened, in these only row groups
    whose filter holds one, and in those only pages whose range does."""
    if len(keys) > LISTED_KEYS:
        raise ValueError(f"{len(keys)} keys: join a table of them instead")
    if not keys:
        return read_all(spark, root).where(F.lit(False))
    paths = _files_of(spark, root, F.exists(F.lit(keys), lambda k: (F.col("low") <= k) & (F.col("high") >= k)))
    if not paths:
        return read_all(spark, root).where(F.lit(False))
    # Few keys as a disjunction: each is looked up in the filters, where a list of many is pushed as its range only.
    match = F.col(key).isin(keys) if len(keys) > 8 else F.lit(False)
    if len(keys) <= 8:
        for k in keys:
            match = match | (F.col(key) == F.lit(k))
    return spark.read.parquet(*paths).where(match)


def read_page(spark: SparkSession, root: str, key: str, limit: int, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of a unique ``key``, as ``orderBy(key).offset(offset).limit(limit)`` gives them, by a seek.

    The directory names the files that hold the page, the marks around it the keys between which it lies; only that range is read.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    files = spark.read.parquet(f"{root}/files").where((F.col("first") < offset + limit) & (F.col("first") + F.col("rows") > offset)).orderBy("first").collect()
    if not files:
        return read_all(spark, root).where(F.lit(False))
    here, last = offset - files[0]["first"], offset + limit - files[-1]["first"]
    marks = spark.read.parquet(f"{root}/marks")
    start = marks.where((F.col("file") == files[0]["file"]) & (F.col("at") <= here)).orderBy(F.desc("at")).first()
    stop = marks.where((F.col("file") == files[-1]["file"]) & (F.col("at") >= last)).orderBy("at").first()
    rows = spark.read.parquet(*[f"{root}/data/{r['file']}" for r in files])
    skip = here
    if start is not None and start["key"] is not None:
        rows, skip = rows.where(F.col(key) >= F.lit(start["key"])), here - start["from"]
    if stop is not None and stop["key"] is not None:
        rows = rows.where((F.col(key) <= F.lit(stop["key"])) | F.col(key).isNull()) if skip == here else rows.where(F.col(key) <= F.lit(stop["key"]))
    return rows.orderBy(F.asc_nulls_first(key)).offset(skip).limit(limit)
