"""Ranked selection per group, plain and diverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.operators.skew import join_key_stats
from shelfsense.session import ensure_checkpoint_dir


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group; tasks cut to ``n`` per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit_vector(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def max_similarity(vector: Column, kept: Column) -> Column:
    """Largest dot product with the kept vectors, NULL when none are kept."""
    return F.array_max(F.transform(kept, lambda k: dot(k, vector)))


def _greedy(ranked: Column, limit: int, threshold: float) -> Column:
    """Scan in order; keep a row unless it is too similar to one kept before it."""
    def step(kept: Column, row: Column) -> Column:
        near = F.exists(kept, lambda k: dot(k["vector"], row["vector"]) >= threshold)
        return F.when((F.size(kept) >= limit) | near, kept).otherwise(F.array_append(kept, row))

    return F.aggregate(ranked, F.slice(ranked, 1, 0), step)


def diverse_selection(df: DataFrame, keys: list[str], place: list[Column], row_id: str, vector: str,
                      limit: int = 6, threshold: float = 0.82, carry: list[str] = (), block: int = 256) -> DataFrame:
    """Per group the best ``limit`` rows, with near-duplicates of better rows put back behind the others.

    ``place`` are ascending sort columns making a total order (negate numbers for descending). Result: keys,
    ``position`` (1.. in that order), the row id, ``kept`` (false for rows that only fill up) and ``carry``.
    Groups of at most ``limit`` rows are returned whole.

    Almost every group is settled by its best ``block`` rows, a bounded array. Where those hold fewer than
    ``limit`` dissimilar rows and the group goes on, the scan continues as passes over the table, each finding the
    next row to keep by a map-side combined minimum, so a group is never gathered in one task. There are
    at most ``limit`` passes, and none when no group needs them. Runs jobs: the per-group state is
    checkpointed.
    """
    if block <= limit:
        raise ValueError("block must be larger than limit")
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(
        *keys, F.struct(*place).alias("_place"),
        F.struct(F.struct(*place).alias("place"), F.col(row_id).alias("id"), F.col(vector).alias("vector"),
                 F.struct(F.lit(0).alias("_"), *carry).alias("carry")).alias("_row"),
    )
    head = top_n(base, keys, [F.col("_place")], block).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_row")).alias("_head")
    )
    kept = F.when(F.size("_head") <= limit, F.col("_head")).otherwise(_greedy(F.col("_head"), limit, threshold))
    state = (
        head.withColumn("_kept", kept)
        .withColumn("_open", (F.size("_head") == block) & (F.size("_kept") < limit))
        .withColumn("_last", F.element_at("_head", -1)["place"])
        .withColumn("_rest", F.slice(
            F.filter("_head", lambda h: ~F.exists(F.col("_kept"), lambda k: k["place"] == h["place"])), 1, limit))
        .drop("_head")
        .checkpoint()
    )
    for _ in range(limit):
        unsettled = state.where("_open")
        if unsettled.isEmpty():
            break
        # only vectors meet the base, not what is carried along
        vectors = F.transform("_kept", lambda k: F.struct(k["vector"].alias("vector")))
        wanted = unsettled.select(*keys, vectors.alias("_kept"), "_last")
        sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).join(wanted, keys)
        met = join_key_stats(base, sizes, keys, "_size", F.col("_place"))
        following = (
            met.where(F.col("_place") > F.col("_last"))
            .where(~F.exists("_kept", lambda k: dot(k["vector"], F.col("_row.vector")) >= threshold))
            .groupBy(*keys).agg(F.min_by("_row", "_place").alias("_next"))
        )
        state = (
            state.join(following, keys, "left")
            .withColumn("_kept", F.when(F.col("_next").isNotNull(), F.array_append("_kept", F.col("_next")))
                        .otherwise(F.col("_kept")))
            .withColumn("_last", F.coalesce(F.col("_next.place"), F.col("_last")))
            .withColumn("_open", F.col("_open") & F.col("_next").isNotNull() & (F.size("_kept") < limit))
            .drop("_next")
            .checkpoint()
        )

    def flagged(rows: Column, flag: bool) -> Column:
        return F.transform(rows, lambda r: F.struct(r["place"].alias("place"), r["id"].alias("id"),
                                                    F.lit(flag).alias("kept"), r["carry"].alias("carry")))

    fill = F.slice("_rest", F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.size("_kept")))
    chosen = F.sort_array(F.concat(flagged(F.col("_kept"), True), flagged(fill, False)))
    return (
        state.select(*keys, F.posexplode(chosen).alias("_at", "_row"))
        .select(*keys, (F.col("_at") + 1).alias("position"), F.col("_row.id").alias(row_id), "_row.kept",
                *[F.col(f"_row.carry.{c}").alias(c) for c in carry])
    )


def similarity_to_kept(df: DataFrame, selected: DataFrame, keys: list[str], row_id: str, vector: str) -> DataFrame:
    """Each row's largest similarity with its group's kept rows: at most ``limit`` products per row."""
    kept = selected.where("kept").select(*keys, row_id).join(df.select(*keys, row_id, vector), [*keys, row_id])
    arrays = kept.groupBy(*keys).agg(F.collect_list(vector).alias("_kept"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).join(arrays, keys)
    met = join_key_stats(df, sizes, keys, "_size", F.col(row_id))
    return met.withColumn("max_similarity", max_similarity(F.col(vector), F.col("_kept"))).drop("_kept", "_size")
