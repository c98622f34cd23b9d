"""Reproducible train, validation and test splits in the order of a seeded hash.

The order of a split is md5(seed|id). Where each part ends is one hash per label, so assigning rows is a comparison
with a handful of broadcast values: the table itself is neither sorted nor shuffled. Ids are expected to be unique.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.operators.skew import bucket_counts, order_hash, rank_cuts
from shelfsense.schemas import SENTIMENTS

_ORDER = "_order"


def check_fractions(test_size: float, val_size: float) -> float:
    """The share of the validation part in what the test part leaves."""
    share = val_size / (1.0 - test_size)
    if not 0.0 < share < 1.0:
        raise ValueError("invalid split: 0 < val_size < 1 - test_size must hold")
    return share


def quotas(sizes: DataFrame, label: str, size: str, share: float, out: str) -> DataFrame:
    """Rows each label gives to a part of ceil(n * share) rows: proportional, the remainder one each to
    the labels with the largest fractions (ties by label). ``sizes`` has one row per label."""
    whole = W.partitionBy(F.lit(1))
    total = F.ceil(F.sum(size).over(whole) * F.lit(share))
    exact = F.col(size) * F.col("_total") / F.sum(size).over(whole)
    by_fraction = W.partitionBy(F.lit(1)).orderBy((F.col("_exact") - F.col("_base")).desc(), F.col(label))
    return (
        sizes.withColumn("_total", total)
        .withColumn("_exact", exact)
        .withColumn("_base", F.floor("_exact"))
        .withColumn("_left", F.col("_total") - F.sum("_base").over(whole))
        .withColumn(out, (F.col("_base") + (F.row_number().over(by_fraction) <= F.col("_left")).cast("int")).cast("bigint"))
        .drop("_total", "_exact", "_base", "_left")
    )


def _checked(df: DataFrame, label: str, labels) -> DataFrame:
    """A row whose label is NULL or not among ``labels`` fails the job and is named: no row leaves a split unseen."""
    value = F.col(label)
    wrong = F.raise_error(F.concat(F.lit(f"label outside {', '.join(map(str, labels))}: "), F.coalesce(value.cast("string"), F.lit("NULL")))).cast(df.schema[label].dataType)
    return df.withColumn(label, F.when(value.isin(*labels), value).otherwise(wrong))


def _with_cuts(df: DataFrame, counts: DataFrame, wanted: DataFrame, stratum: str, labels, n_cuts: int) -> DataFrame:
    """Each row with the array ``_cuts`` of its label's cut hashes, in cut order; one row per label is broadcast."""
    found = rank_cuts(df, counts, wanted, stratum, _ORDER)
    per_label = (
        found.where(F.col(stratum).isin(*labels))
        .groupBy(stratum)
        .agg(*[F.min(F.when(F.col("cut") == i, F.col("hash"))).alias(f"_c{i}") for i in range(n_cuts)])
    )
    return df.join(F.broadcast(per_label), stratum)


def stratified_split(df: DataFrame, label: str = "sentiment_label", row_id: str = "review_id", test_size: float = 0.15,
                     val_size: float = 0.15, seed: int = 42, labels=SENTIMENTS) -> DataFrame:
    """Add ``split`` (test, val, train): exact sizes, each label in proportion, parts disjoint. Other labels fail."""
    val_share = check_fractions(test_size, val_size)
    hashed = _checked(df, label, labels).withColumn(_ORDER, order_hash(seed, F.col(row_id)))
    counts = bucket_counts(hashed, label, _ORDER)
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("_size"))
    wanted = quotas(sizes, label, "_size", test_size, "_test")
    wanted = quotas(wanted.withColumn("_rest", F.col("_size") - F.col("_test")), label, "_rest", val_share, "_val")
    wanted = wanted.select(
        label,
        F.inline(F.array(
            F.struct(F.lit(0).alias("cut"), F.col("_test").alias("rank")),
            F.struct(F.lit(1).alias("cut"), (F.col("_test") + F.col("_val")).alias("rank")),
        )),
    )
    marked = _with_cuts(hashed, counts, wanted, label, labels, 2)
    split = F.when(F.col(_ORDER) <= F.col("_c0"), "test").when(F.col(_ORDER) <= F.col("_c1"), "val").otherwise("train")
    return marked.withColumn("split", split).select(*df.columns, "split")


def stratified_folds(df: DataFrame, label: str = "sentiment_label", row_id: str = "review_id", folds: int = 5,
                     seed: int = 42, labels=SENTIMENTS) -> DataFrame:
    """Add ``fold`` 1..folds: each label cut into equal runs of the hash order, the first runs one longer. Other labels
    fail."""
    hashed = _checked(df, label, labels).withColumn(_ORDER, order_hash(seed, F.col(row_id)))
    counts = bucket_counts(hashed, label, _ORDER)
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("_size"))
    base, extra = F.floor(F.col("_size") / folds), F.col("_size") % folds
    wanted = sizes.select(
        label,
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("cut"), (base * (i + 1) + F.least(F.lit(i + 1), extra)).cast("bigint").alias("rank"))
            for i in range(folds - 1)
        ])),
    )
    marked = _with_cuts(hashed, counts, wanted, label, labels, folds - 1)
    fold = F.lit(1)
    for i in range(folds - 1):
        fold = fold + (F.col(_ORDER) > F.col(f"_c{i}")).cast("int")
    return marked.withColumn("fold", fold).select(*df.columns, "fold")


def group_split(df: DataFrame, group: str = "product_id", test_size: float = 0.2, val_fraction_of_temp: float = 0.5,
                seed: int = 42) -> DataFrame:
    """Add ``split`` so that no group is in two parts: ceil(test_size * groups) groups leave the training part, and
    ceil((1 - val_fraction) * those) of them form the test part, the rest validation. Counts the groups first."""
    groups = (
        df.where(F.col(group).isNotNull()).select(group).distinct()
        .withColumn("_all", F.lit("all")).withColumn(_ORDER, order_hash(seed, F.col(group)))
    )
    counts = bucket_counts(groups, "_all", _ORDER)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if total < 3:
        raise ValueError("need at least 3 groups for a grouped train/val/test split")
    temp = math.ceil(total * test_size)
    test = math.ceil(temp * (1.0 - val_fraction_of_temp))
    if not 0 < test < temp < total:
        raise ValueError(f"{total} groups cannot fill train, val and test with test_size={test_size}")
    wanted = counts.sparkSession.createDataFrame([("all", 0, test), ("all", 1, temp)], "_all string, cut int, rank bigint")
    cuts = rank_cuts(groups, counts, wanted, "_all", _ORDER).agg(
        F.struct(
            F.min(F.when(F.col("cut") == 0, F.col("hash"))).alias("test"),
            F.min(F.when(F.col("cut") == 1, F.col("hash"))).alias("temp"),
        )
    ).scalar()
    at = order_hash(seed, F.col(group))
    return (
        df.where(F.col(group).isNotNull()).withColumn("_cuts", cuts)
        .withColumn("split", F.when(at <= F.col("_cuts.test"), "test").when(at <= F.col("_cuts.temp"), "val").otherwise("train"))
        .drop("_cuts")
    )


def split_summary(df: DataFrame, group: str = "product_id") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct(group).alias("product_count")
    )
