"""Distinct counts over many runs from stored sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^12 registers: a relative standard error of 1.04 / 64, about 1.6 %.
LOG_REGISTERS = 12
STANDARD_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)


def distinct_sketches(df: DataFrame, runs: list[str], counted: dict[str, Column]) -> DataFrame:
    """One row per run (``runs``, the columns that tell runs apart) and counted thing: runs, name, sketch. Nulls are not counted. Sketches of a few KB merge
    before the shuffle, so a run of any size costs one a task; stored, they answer for any union of runs without its rows."""
    wide = df.groupBy(*runs).agg(*[F.hll_sketch_agg(F.xxhash64(c), F.lit(LOG_REGISTERS)).alias(n) for n, c in _named(counted)])
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("sketch")) for n in counted])
    return wide.select(*runs, F.inline(cells))


def _named(counted: dict[str, Column]) -> list[tuple[str, Column]]:
    # A null among the parts of a thing leaves it out, as a distinct count does.
    return [(n, F.when(c.isNotNull(), c)) for n, c in counted.items()]


def merged_counts(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Estimated distinct counts per name (and ``by``) over all runs in ``sketches``, within about three standard errors."""
    return sketches.groupBy(*(by or []), "name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
