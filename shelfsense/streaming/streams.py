"""Incremental forms of the batch operators for reviews and requests that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfsense.operators.sentiment import distribution_columns
from shelfsense.operators.stats import histogram
from shelfsense.plans.insights import upsert
from shelfsense.plans.ingest import typed_reviews
from shelfsense.session import scratch_path
from shelfsense.sources.tables import create_buckets, drop_superseded, read_buckets, read_versions, touched_buckets, write_buckets


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(folder)


def first_arrivals(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats that arrive within ``delay``; state older than that is forgotten."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def review_stream(source: DataFrame, delay: str = "7 days") -> DataFrame:
    """Source records as typed reviews, the first of each (product, text, time). Records without a time carry no
    event time and are left to the batch job."""
    typed = typed_reviews(source).withColumn("event_time", F.timestamp_millis("timestamp")).where("event_time IS NOT NULL")
    return first_arrivals(typed, ["product_id", "review_text", "timestamp"], "event_time", delay)


def running_distribution(stream: DataFrame, keys: list[str], event_time: str, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Label counts so far per time window and key; needs ``sentiment_label`` and ``sentiment_source``. Windows older than ``delay`` leave the
    state; ``total_distribution`` adds up the windows that were written."""
    marked = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("_window"), *keys)
    return marked.agg(*distribution_columns()).withColumn("window_start", F.col("_window.start")).drop("_window")


def total_distribution(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ratios over all windows of ``running_distribution``."""
    counts = [c for c in windows.columns if c.endswith(("_count", "_source")) or c == "total"]
    summed = windows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    labels = [c.removesuffix("_count") for c in counts if c.endswith("_count")]
    return summed.select("*", *[F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col(f"{s}_count") / F.col("total"), 4)).alias(f"{s}_ratio") for s in labels])


def windowed_histogram(stream: DataFrame, event_time: str, width: str, keys: list[str], value: str, buckets, delay: str) -> DataFrame:
    """Cumulative bucket counts per time window and key; events later than ``delay`` are dropped."""
    marked = stream.withWatermark(event_time, delay).withColumn("_window", F.window(event_time, width))
    return histogram(marked, ["_window", *keys], value, buckets).withColumn("window_start", F.col("_window.start")).drop("_window")


def run_available(stream: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Process what is there and stop; every batch is written to its own folder, so a repeated batch overwrites itself.

    The result has a ``batch`` column.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/out")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every updated row."""
    last = W.partitionBy(*keys).orderBy(F.desc("batch"))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")


def refresh_insights(arrivals: DataFrame, all_reviews: Callable[[], DataFrame] | None, compute: Callable[[DataFrame], DataFrame],
                     root: str, key: str = "product_id", buckets: int | None = None, slices: int = 1) -> StreamingQuery:
    """Recompute insights of the products each batch touches and upsert them into a table laid out by bucket (``read_buckets``).

    ``compute`` turns reviews into rows with product, version, payload and creation time. ``all_reviews`` gives the current review table; without it, arrivals
    are whole reviews that every batch adds to ``root/reviews``, laid out by the same buckets, and a batch reads back only the buckets its
    products fall into. It replaces only these buckets of ``root/table``, and merges into the newest version of them before its own number, so
    running it again gives the same. ``buckets`` fixes the number for new tables. The last few versions of the insights are kept.
    """
    if buckets is not None:
        create_buckets(arrivals.sparkSession, f"{root}/table", buckets)
        create_buckets(arrivals.sparkSession, f"{root}/reviews", buckets)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(key).where(F.col(key).isNotNull()).distinct()
        named = touched_buckets(touched, f"{root}/table", key)
        if all_reviews is None:
            write_buckets(batch, f"{root}/reviews", key, number, slices)
            reviews = read_versions(spark, f"{root}/reviews", named, number)
        else:
            reviews = all_reviews()
        if not named:
            return
        fresh = compute(reviews.join(touched, key, "left_semi"))
        held = read_buckets(spark, f"{root}/table", named, number)
        write_buckets(upsert(held, fresh) if held is not None else fresh, f"{root}/table", key, number, slices)
        drop_superseded(spark, f"{root}/table")

    return (
        arrivals.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(merge).start()
    )
