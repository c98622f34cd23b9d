"""Joins, selections and order statistics that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.session import ensure_checkpoint_dir

# A key is hot above this many rows; a hot key is cut into slices of about this size.
HOT_ROWS = 2_000_000
# No more keys than this can be hot: the threshold also scales with the table, so what is broadcast is
# bounded whatever the data size.
MAX_HOT_KEYS = 50_000


def join_key_stats(df: DataFrame, stats: DataFrame, keys: str | list[str], rows: str, row_id: Column,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``df`` with ``stats``: one row per key, ``rows`` counting the key's rows in ``df``.

    Rows of a hot key are spread over slices by a hash of ``row_id``, and the key's one stats row is repeated
    per slice, so no task receives a whole hot key. ``row_id`` must be deterministic, or a retried task would
    reshuffle rows differently. Hot keys come from ``stats``, whose exchange the join reuses.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    # hot: more than max(hot_rows, all rows / MAX_HOT_KEYS) rows, so there are at most MAX_HOT_KEYS of them
    floor = F.greatest(F.lit(float(hot_rows)), df.agg(F.count(F.lit(1)) / F.lit(MAX_HOT_KEYS)).scalar())

    def slices(n: Column) -> Column:
        return F.when(n > floor, F.ceil(n / F.lit(float(hot_rows)))).otherwise(F.lit(1)).cast("int")

    hot = stats.where(F.col(rows) > floor).select(*keys, slices(F.col(rows)).alias("_slices"))
    slice_of = F.pmod(F.xxhash64(row_id), F.coalesce(F.col("_slices"), F.lit(1))).cast("int")
    sliced = df.join(F.broadcast(hot), keys, "left").withColumn("_slice", slice_of).drop("_slices")
    repeated = stats.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices(F.col(rows)) - 1)))
    return sliced.join(repeated, [*keys, "_slice"]).drop("_slice")


# Hash-ordered selection -------------------------------------------------------------------------------

_BUCKET_DIGITS = 4  # leading hex digits of the md5: 65,536 even buckets


def order_hash(seed: int | str, value: Column) -> Column:
    """The reproducible random order used by every split: md5 of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), value.cast("string")))


def bucket_counts(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """Rows per stratum and leading digits of the hash; at most 65,536 rows per stratum."""
    return df.groupBy(stratum, F.substring(order, 1, _BUCKET_DIGITS).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n")
    )


def rank_cuts(df: DataFrame, counts: DataFrame, wanted: DataFrame, stratum: str, order: str) -> DataFrame:
    """The hash at given ranks of each stratum, without ranking the table.

    ``wanted`` has (stratum, cut, rank). Bucket counts say which bucket holds the rank; only that bucket's
    rows (1/65,536 of a stratum) are ranked. A row is among the first ``rank`` rows of its stratum exactly
    when its hash is not above the cut. Rank 0 gives the empty text.
    """
    upto = W.partitionBy(stratum).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = counts.withColumn("_upto", F.sum("_n").over(upto))
    located = (
        running.join(wanted, stratum)
        .where((F.col("rank") > F.col("_upto") - F.col("_n")) & (F.col("rank") <= F.col("_upto")))
        .select(stratum, "cut", "_bucket", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_offset"))
    )
    rows = df.select(stratum, order, F.substring(order, 1, _BUCKET_DIGITS).alias("_bucket")).join(
        F.broadcast(located), [stratum, "_bucket"]
    )
    in_bucket = W.partitionBy(stratum, "_bucket", "cut").orderBy(order)
    found = (
        rows.withColumn("_rank", F.row_number().over(in_bucket))
        .where(F.col("_rank") == F.col("_offset"))
        .select(stratum, "cut", F.col(order).alias("hash"))
    )
    none = wanted.where("rank <= 0").select(stratum, "cut", F.lit("").alias("hash"))
    return found.unionByName(none)


# Row numbers ------------------------------------------------------------------------------------------

def dense_ordinal(df: DataFrame, position: str, out: str) -> DataFrame:
    """Number the rows 1..n in the order of a unique ``position`` of any spread without sorting them in one task.

    Rows are range-partitioned by sampled quantiles of the position and kept in the shared folder, so that their partitions stay as they are;
    the partitions' counts, one row each, give each partition its start.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, position).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("_range").orderBy(position)
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(starts, "_range")
        .withColumn(out, (F.col("_start") + F.col("_at")).cast("bigint"))
        .drop("_range", "_at", "_start")
    )


def number_in_file_order(scan: DataFrame, keep: Column, out: str) -> DataFrame:
    """The rows of a file scan that meet ``keep``, numbered 1..n in source order: files by path, rows as they lie in them. No row moves.

    A task reads pieces of files one after the other. Rows that pass the filter get ascending numbers in their task, so within a piece they are a
    run; the pieces' counts, one row each, are summed in the order of path and place and broadcast back. Both passes read the same pieces, as
    these follow from the files alone. ``scan`` must come straight from a file source.
    """
    piece = scan.where(keep).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                    F.monotonically_increasing_id().alias("_at"))
    counts = piece.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_least"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    # A row per piece, 128 MB of input each: 100 TB are below a million of them.
    return piece.join(F.broadcast(starts), ["_file", "_block"]).withColumn(out, F.col("_at") + F.col("_shift") + 1).drop("_file", "_block", "_at", "_shift")


# Order statistics -------------------------------------------------------------------------------------

# Rank error of the sketch is 1/ACCURACY of the rows; the bracket around each rank is twice as wide.
# Groups of at most SMALL rows are bracketed by their own minimum and maximum.
ACCURACY = 10_000
SMALL = 20_000
# A verified bracket with more rows is cut into so many parts of equal width, of which the one with the rank stays.
PARTS = 1_024
# Rounds of cutting; each narrows a bracket by PARTS, so the width of a double is used up well before.
ROUNDS = 40


def _guess(shares: list[float]) -> Column:
    """Low and high end of a bracket per share, from a sketch; small groups take their whole range."""
    slack = 2.0 / ACCURACY
    edges = [e for p in shares for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = F.percentile_approx("_v", edges, ACCURACY)
    whole = F.count(F.lit(1)) <= SMALL
    return F.array(*[F.struct(F.when(whole, F.min("_v")).otherwise(sketch[2 * i]).alias("low"), F.when(whole, F.max("_v")).otherwise(sketch[2 * i + 1]).alias("high"))
                     for i in range(len(shares))])


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Column]],
                     guess: Callable[[list[float]], Column] = _guess) -> DataFrame:
    """Exact values at given 0-based ranks per group, one row per group, for groups of any size.

    ``ranks`` maps a name to (p, rank): the rank as an expression of ``n``, the group's row count, and the share p
    it stands for (rank is p * (n - 1) to within one). ``guess`` proposes a bracket of values per share. A count of the rows below and inside
    tells whether the bracket holds its ranks. One that does not is widened to the end of the group on the side where they lie, and what is
    then too wide is narrowed by histograms of equal width, whose parts are counted too: no bracket is used unverified. Only values inside the
    brackets are grouped; all others are folded into counts in the task that reads them. Nulls are left out; a NaN counts as the largest value.
    """
    names = list(ranks)
    shares = sorted({p for p, _ in ranks.values()})
    at = {name: shares.index(p) for name, (p, _) in ranks.items()}
    valued = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = valued.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), guess(shares).alias("_b"))

    def span(i: int) -> list[Column]:
        wanted = [r.cast("bigint") for p, r in ranks.values() if p == shares[i]]
        return [F.least(*wanted, wanted[0]).alias("first"), F.greatest(*wanted, wanted[0]).alias("last")]

    guessed = sizes.select(*keys, "_min", "_max", F.posexplode(F.arrays_zip(F.col("_b"), F.array(*[F.struct(*span(i)) for i in range(len(shares))]).alias("_r"))).alias("share", "_x")).select(
        *keys, "_min", "_max", "share", "_x._b.low", "_x._b.high", "_x._r.first", "_x._r.last")
    brackets = _verified(valued, guessed, keys, len(shares))
    for _ in range(ROUNDS):
        wide = (F.col("_rows") > SMALL) & (F.col("low") < F.col("high")) & ~F.isnan("high") & (F.abs("low") != float("inf")) & (F.col("high") != float("inf"))
        if not brackets.where(wide).limit(1).count():
            break
        brackets = _narrowed(valued, brackets, keys, wide)
    inside = _inside(valued, brackets.select(*keys, "share", "low", "high"), keys)
    counted = inside.groupBy(*keys, "share", "_v").agg(F.count(F.lit(1)).alias("_c")).join(brackets.select(*keys, "share", "_below"), [*keys, "share"])
    order = W.partitionBy(*keys, "share").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.withColumn("_upto", F.col("_below") + F.sum("_c").over(order)).join(sizes.select(*keys, "n"), keys)
    return placed.groupBy(*keys).agg(*[
        F.min(F.when((F.col("share") == at[k]) & (F.col("_upto") > ranks[k][1].cast("bigint")), F.col("_v"))).alias(k) for k in names])


def _inside(valued: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per value and bracket that holds it. The brackets of a group travel as one list, so rows outside all of them end here."""
    lists = brackets.groupBy(*keys).agg(F.collect_list(F.struct("share", "low", "high")).alias("_b"))
    held = F.filter("_b", lambda b: (F.col("_v") >= b["low"]) & (F.col("_v") <= b["high"]))
    return valued.join(lists, keys).select(*keys, "_v", F.explode(held).alias("_b")).select(*keys, "_v", "_b.share", "_b.low", "_b.high")


def _counts(valued: DataFrame, brackets: DataFrame, keys: list[str], shares: int) -> DataFrame:
    """(keys, share, _below, _rows): rows below and inside each bracket, counted before anything is shuffled."""
    ends = brackets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("share", F.struct("low", "high")))).alias("_b"))
    joined = valued.join(ends, keys)
    wide = joined.groupBy(*keys).agg(*[c for i in range(shares) for c in (
        F.count_if(F.col("_v") < F.col("_b")[i]["low"]).alias(f"_l{i}"), F.count_if(F.col("_v").between(F.col("_b")[i]["low"], F.col("_b")[i]["high"])).alias(f"_i{i}"))])
    cells = F.array(*[F.struct(F.lit(i).alias("share"), F.col(f"_l{i}").alias("_below"), F.col(f"_i{i}").alias("_rows")) for i in range(shares)])
    return wide.select(*keys, F.inline(cells))


def _verified(valued: DataFrame, guessed: DataFrame, keys: list[str], shares: int) -> DataFrame:
    """Brackets that hold their ranks, with the rows below (``_below``) and inside (``_rows``). A bracket that misses is widened to the end of the group
    on the side of the miss, which holds by construction, and counted again."""
    counted = guessed.join(_counts(valued, guessed, keys, shares), [*keys, "share"])
    under, over = F.col("first") < F.col("_below"), F.col("last") >= F.col("_below") + F.col("_rows")
    widened = counted.select(*keys, "share", "first", "last", F.when(under, F.col("_min")).otherwise(F.col("low")).alias("low"),
                             F.when(over, F.col("_max")).otherwise(F.col("high")).alias("high"), "_below", "_rows", (under | over).alias("_missed"))
    if not widened.where("_missed").limit(1).count():
        return widened.drop("_missed")
    again = _counts(valued, widened, keys, shares)
    return widened.drop("_below", "_rows", "_missed").join(again, [*keys, "share"])


def _narrowed(valued: DataFrame, brackets: DataFrame, keys: list[str], wide: Column) -> DataFrame:
    """Wide brackets cut into parts of equal width; the parts from the first rank to the last stay. Part counts merge, so a group costs at most PARTS rows a task."""
    cut = brackets.where(wide)
    part = F.least(F.floor((F.col("_v") - F.col("low")) / (F.col("high") / PARTS - F.col("low") / PARTS)), F.lit(PARTS - 1))
    parts = _inside(valued, cut.select(*keys, "share", "low", "high"), keys).groupBy(*keys, "share", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = W.partitionBy(*keys, "share").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(cut.select(*keys, "share", "first", "last", "_below"), [*keys, "share"])
    start = F.col("_below") + F.col("_before")
    kept = placed.where((start <= F.col("last")) & (start + F.col("_c") > F.col("first"))).groupBy(*keys, "share", "first", "last").agg(
        F.min("_low").alias("low"), F.max("_high").alias("high"), F.min(start).alias("_below"), F.sum("_c").alias("_rows"))
    columns = [*keys, "share", "first", "last", "low", "high", "_below", "_rows"]
    out = brackets.where(~wide).select(*columns).unionByName(kept.select(*columns))
    ensure_checkpoint_dir(valued.sparkSession)
    return out.checkpoint()
