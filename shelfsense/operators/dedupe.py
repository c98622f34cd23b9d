"""Keep-first duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row per key in the given total order; NULL keys are equal to each other.

    The rank filter lets every task drop all but its own first copy before the shuffle, so a text copied a billion
    times sends one row per task. A hash of the keys leads the sort: long texts are rarely compared.
    """
    first = W.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def all_columns(df: DataFrame) -> list[Column]:
    """The order of a table whose rows have no position: all columns as text, so that a repeated task keeps the same row."""
    return [F.col(c).cast("string") for c in df.columns]
