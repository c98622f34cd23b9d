"""Latency, status, outcome and histogram statistics of request and job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.operators.skew import order_statistics

# Percentiles reported, and the histogram bounds in seconds.
LINEAR_PERCENTILES = (50, 55, 90, 95, 99)
REQUEST_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# The same for jobs and for generated summaries, to be passed as ``buckets``.
JOB_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0)
SUMMARY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def _plain(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("_mean"), F.min(v).alias("_min"), F.max(v).alias("_max")
    )


def latency_linear(df: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Mean, range and linearly interpolated percentiles per group, two decimals."""
    ranks: dict[str, tuple[float, Column]] = {}
    for p in LINEAR_PERCENTILES:
        at = (F.col("n") - 1) * F.lit(p / 100)
        ranks[f"_lo{p}"] = (p / 100, F.floor(at))
        ranks[f"_hi{p}"] = (p / 100, F.ceil(at))
    joined = _plain(df, keys, value).join(order_statistics(df, keys, value, ranks), keys)

    def percentile(p: int) -> Column:
        at = (F.col("n") - 1) * F.lit(p / 100)
        low, high = F.col(f"_lo{p}"), F.col(f"_hi{p}")
        return F.round(low + (high - low) * (at - F.floor(at)), 2).alias(f"p{p}_ms")

    return joined.select(
        *keys, F.col("n").alias("count"), F.round("_mean", 2).alias("mean_ms"), F.round("_min", 2).alias("min_ms"),
        F.round("_max", 2).alias("max_ms"), *[percentile(p) for p in LINEAR_PERCENTILES],
    )


def latency_nearest(df: DataFrame, keys: list[str], value: str = "latency_ms", status: str = "status") -> DataFrame:
    """Requests, success rate and nearest-rank percentiles (half to even) per group, two decimals."""
    shares = {50: 0.50, 95: 0.95, 99: 0.99}
    ranks = {f"_p{p}": (s, F.bround((F.col("n") - 1) * F.lit(s), 0)) for p, s in shares.items()}
    # a group whose requests have no latency keeps its counts, with latencies of 0
    measured = _plain(df, keys, value).join(order_statistics(df, keys, value, ranks), keys)
    joined = status_summary(df, keys, status).join(measured, keys, "left")

    def shown(column: str, out: str) -> Column:
        return F.coalesce(F.round(column, 2), F.lit(0.0)).alias(out)

    return joined.select(
        *keys, "requests", "success_count", "success_rate", shown("_mean", "avg_ms"),
        *[shown(f"_p{p}", f"p{p}_ms") for p in shares], shown("_min", "min_ms"), shown("_max", "max_ms"),
    )


def latency_floor(df: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """Median and the value at rank floor(0.95 * (n - 1)) per group, two decimals."""
    last = F.col("n") - 1
    ranks = {
        "_m0": (0.5, F.floor(last / 2)), "_m1": (0.5, F.ceil(last / 2)), "_p95": (0.95, F.floor(last * F.lit(0.95))),
    }
    joined = _plain(df, keys, value).join(order_statistics(df, keys, value, ranks), keys)
    return joined.select(
        *keys, F.col("n").alias("count"), F.round("_min", 2).alias("min_ms"), F.round("_max", 2).alias("max_ms"),
        F.round("_mean", 2).alias("mean_ms"), F.round((F.col("_m0") + F.col("_m1")) / 2, 2).alias("p50_ms"),
        F.round("_p95", 2).alias("p95_ms"),
    )


def status_summary(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    good = F.count_if((F.col(status) >= 200) & (F.col(status) < 300))
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        total.alias("requests"), good.alias("success_count"), F.round(good / total, 4).alias("success_rate")
    )


def status_counts(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("request_count"))


def job_outcomes(df: DataFrame, keys: list[str], status: str = "status", duration: str = "duration") -> DataFrame:
    """Finished, failed and other jobs, success rate, mean and longest duration."""
    total = F.count(F.lit(1))
    finished = F.count_if(F.col(status) == "finished")
    failed = F.count_if(F.col(status) == "failed")
    return df.groupBy(*keys).agg(
        total.alias("job_count"), finished.alias("finished_count"), failed.alias("failed_count"),
        (total - finished - failed).alias("other_count"), F.round(finished / total, 4).alias("success_rate"),
        F.count(duration).alias("duration_count"), F.round(F.avg(duration), 2).alias("duration_mean"),
        F.round(F.max(duration), 2).alias("duration_max"),
    )


def histogram(df: DataFrame, keys: list[str | Column], value: str, buckets=REQUEST_BUCKETS) -> DataFrame:
    """Cumulative counts per bucket bound, the last bound being infinity, with the group's count and sum."""
    bounds = [*buckets, float("inf")]
    wide = df.groupBy(*keys).agg(
        F.sum(value).alias("value_sum"), F.count(value).alias("value_count"),
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
    )
    names = [c for c in wide.columns if not c.startswith("_b")]
    cells = [
        F.struct(F.lit("+Inf" if b == float("inf") else repr(b)).alias("le"),
                 (F.col(f"_b{i}") if i < len(buckets) else F.col("value_count")).alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    return wide.select(*names, F.inline(F.array(*cells)))


def value_counts(df: DataFrame, column: str, out: str = "row_count") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), column)


def flatten_metrics(df: DataFrame) -> DataFrame:
    """Numeric fields of nested structs as (name, value) rows, names joined by underscores; booleans are left out."""
    from pyspark.sql import types as T

    found: list[Column] = []

    def walk(fields, path: list[str]) -> None:
        for f in fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, at)
            elif isinstance(f.dataType, T.NumericType):
                found.append(F.struct(F.lit("_".join(at)).alias("name"), F.col(".".join(at)).cast("double").alias("value")))

    walk(df.schema.fields, [])
    return df.select(F.inline(F.array(*found))).where(F.col("value").isNotNull())
