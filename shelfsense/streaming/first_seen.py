"""First of each key by event time and id, whatever the order of arrival: state per key and window with an expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_by_time(stream: DataFrame, keys: list[str], time: str, row_id: str, delay: str) -> DataFrame:
    """For each key the earliest row by (``time``, ``row_id`` as text) of every window of ``delay``, in update mode: a batch gives out the earliest row seen so far
    of the keys and windows that it touches, so each row that comes out is one of the key's, and the first of a key is the earliest of them
    (``earliest``); within a window the last version is right too. Rows older than the watermark may be dropped, a window's state goes when
    the watermark has passed its end. Rows without a time or an id take no part. Needs the RocksDB state store."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    usable = stream.where(F.col(time).isNotNull() & F.col(row_id).isNotNull()).withWatermark(time, delay)
    first = F.min_by(F.struct(*stream.columns), F.struct(F.col(time), F.col(row_id).cast("string")))
    return usable.groupBy(F.window(time, delay).alias("_window"), *keys).agg(first.alias("_first")).select("_first.*")


def earliest(rows: DataFrame, keys: list[str], time: str, row_id: str) -> DataFrame:
    """The first row of each key by (``time``, ``row_id`` as text) of all that ``first_by_time`` gave out, in any order and any number of times."""
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(time), F.col(row_id).cast("string")))
    return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(first.alias("_first")).select("_first.*")
