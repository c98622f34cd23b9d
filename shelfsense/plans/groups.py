"""Product records for the summary dataset: quality, best or diverse reviews per sentiment, one wide row per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.scoring import HARD_MAX, IDEAL_MAX, IDEAL_MIN, WEIGHTS
from shelfsense.functions.text import null_to_blank
from shelfsense.operators.quality import global_quality
from shelfsense.operators.select import diverse_selection, top_n
from shelfsense.schemas import META_COLUMNS, REVIEW_ITEM, SENTIMENTS, require_columns
from shelfsense.session import ensure_checkpoint_dir

GROUP = ["product_id", "sentiment_label"]


def with_text(clean: DataFrame) -> DataFrame:
    require_columns(clean, ["product_id", "sentiment_label", "text", "helpful_vote", "verified_purchase", "text_len", "rating"])
    return clean.withColumn("text", null_to_blank(F.col("text"))).where(F.col("text") != "")


def scored_reviews(clean: DataFrame, weights=WEIGHTS, band=(IDEAL_MIN, IDEAL_MAX, HARD_MAX), range_of: DataFrame | None = None) -> DataFrame:
    """Reviews with text, scored with votes normalised over the whole table."""
    return global_quality(with_text(clean), "text_len", weights, band, range_of)


def group_stats(scored: DataFrame, min_group_size: int = 1, keys=GROUP) -> DataFrame:
    """Size and rating sum of every group that is large enough."""
    return (
        scored.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("group_size"), F.sum("rating").alias("rating_sum"))
        .where(F.col("group_size") >= min_group_size)
    )


def place(tie: list[str]) -> list[Column]:
    """Ascending sort columns of the group ranking; ``tie`` makes the order total."""
    return [(-F.col(c).cast("double")) for c in ("review_quality_score", "helpful_vote", "verified_purchase", "text_len")] + [
        F.col(c) for c in tie
    ]


def group_topk(scored: DataFrame, k: int, tie: list[str], keys=GROUP) -> DataFrame:
    """Best ``k`` reviews of each group as ``position`` 1..k."""
    return top_n(scored, list(keys), place(tie), k, "position")


def selected_reviews(scored: DataFrame, stats: DataFrame, max_reviews: int, tie: list[str], vector: str | None = None,
                     threshold: float = 0.82) -> DataFrame:
    """Selected reviews of large enough groups with their ``position``; diverse when a vector column is named."""
    item = [f.name for f in REVIEW_ITEM.fields if f.name in scored.columns]
    if vector is None:
        best = group_topk(scored, max_reviews, tie).select(*GROUP, "position", *item)
    else:
        carry = [c for c in item if c != "review_id"]
        best = diverse_selection(scored, GROUP, place(tie), "review_id", vector, max_reviews, threshold, carry=carry)
    return best.join(stats.select(*GROUP), GROUP, "left_semi")


def product_groups(clean: DataFrame, max_reviews: int = 5, min_group_size: int = 1, tie: list[str] = ("timestamp", "review_id"),
                   vector: str | None = None, threshold: float = 0.82, weights=WEIGHTS,
                   band=(IDEAL_MIN, IDEAL_MAX, HARD_MAX), sort: bool = True) -> DataFrame:
    """One wide record per product with a group that is large enough.

    Counts, ratios and the mean rating cover only those groups. Per-group numbers are partial aggregates and
    selections are at most ``max_reviews`` rows, so a product of any size becomes a few small rows before it is assembled.

    The texts are scanned twice: once for what range and statistics need, which is kept in the shared folder without them, and once by the ranking,
    where the best rows of each task alone are shuffled.
    """
    meta = [c for c in META_COLUMNS if c in clean.columns]
    ensure_checkpoint_dir(clean.sparkSession)
    narrow = with_text(clean).select(*GROUP, "rating", "helpful_vote", *meta).checkpoint()
    scored = scored_reviews(clean, weights, band, narrow)
    stats = (
        narrow.groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("group_size"), F.sum("rating").alias("rating_sum"),
             *[F.max(c).alias(c) for c in meta])
        .where(F.col("group_size") >= min_group_size)
    )
    picked = selected_reviews(scored, stats, max_reviews, list(tie), vector, threshold)
    fields = [f.name for f in REVIEW_ITEM.fields if f.name in picked.columns]
    lists = picked.groupBy(*GROUP).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("item")))),
                    lambda x: x["item"]).alias("items")
    )
    joined = stats.join(lists, GROUP)

    def of(label: str, value: Column) -> Column:
        return F.when(F.col("sentiment_label") == label, value)

    columns = [F.max(c).alias(c) for c in meta]
    columns += [F.sum("group_size").alias("review_count"), F.sum("rating_sum").alias("_rating_sum")]
    for s in SENTIMENTS:
        columns += [
            F.coalesce(F.sum(of(s, F.col("group_size"))), F.lit(0)).alias(f"{s}_count"),
            F.first(of(s, F.col("items")), ignorenulls=True).alias(f"{s}_review_items"),
        ]
    wide = joined.groupBy("product_id").agg(*columns)
    item_type = joined.schema["items"].dataType
    out = wide.select(
        F.col("product_id").cast("string").alias("product_id"), *meta, "review_count",
        F.round(F.col("_rating_sum") / F.col("review_count"), 4).alias("avg_rating_from_reviews"),
        *[F.col(f"{s}_count") for s in SENTIMENTS],
        *[F.coalesce(F.array_size(f"{s}_review_items"), F.lit(0)).alias(f"{s}_selected_count") for s in SENTIMENTS],
        *[F.coalesce(F.transform(f"{s}_review_items", lambda i: F.coalesce(i["text"], F.lit(""))),
                     F.array().cast("array<string>")).alias(f"{s}_reviews") for s in SENTIMENTS],
        *[F.coalesce(f"{s}_review_items", F.array().cast(item_type)).alias(f"{s}_review_items") for s in SENTIMENTS],
        *[F.round(F.col(f"{s}_count") / F.col("review_count"), 4).alias(f"{s}_ratio") for s in SENTIMENTS],
    )
    return out.orderBy(F.desc("review_count"), "product_id") if sort else out


def scalar_columns(df: DataFrame) -> DataFrame:
    """The frame without its list columns, as the statistics file holds it."""
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)])
