"""Review quality over a whole table: normalised over everything or within each product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.scoring import HARD_MAX, IDEAL_MAX, IDEAL_MIN, WEIGHTS, length_score, min_max, quality, vote_log
from shelfsense.functions.text import token_count
from shelfsense.operators.bind import with_values
from shelfsense.operators.skew import HOT_ROWS, join_key_stats
from shelfsense.schemas import require_columns


def _scored(df: DataFrame, low: Column, high: Column, tokens: Column, weights, band) -> DataFrame:
    ideal_min, ideal_max, hard_max = band
    return (
        df.withColumn("helpful_vote_norm", min_max(vote_log(F.col("helpful_vote")), low, high))
        .withColumn("length_score", length_score(tokens, ideal_min, ideal_max, hard_max))
        .withColumn(
            "review_quality_score",
            quality(F.col("helpful_vote_norm"), F.col("verified_purchase"), F.col("length_score"), weights),
        )
    )


def global_quality(df: DataFrame, tokens: str = "text_len", weights=WEIGHTS,
                   band=(IDEAL_MIN, IDEAL_MAX, HARD_MAX), range_of: DataFrame | None = None) -> DataFrame:
    """Votes normalised over the whole table; the range is a scalar subquery, rows are not shuffled. ``range_of`` holds the same rows' votes where
    that is cheaper to read."""
    require_columns(df, ["helpful_vote", "verified_purchase", tokens])
    votes = F.coalesce(F.col("helpful_vote").cast("double"), F.lit(0.0))
    fewest, most = vote_log(F.min(votes)), vote_log(F.max(votes))
    ends = (df if range_of is None else range_of).agg(F.struct(fewest.alias("low"), most.alias("high")).alias("ends")).scalar()
    ranged = df.withColumn("_ends", ends)
    scored = _scored(ranged, F.col("_ends.low"), F.col("_ends.high"),
                     F.coalesce(F.col(tokens), F.lit(0)), weights, band)
    return scored.drop("_ends")


def product_quality(df: DataFrame, tokens: str | None = "text_len", text: str | None = None, key: str = "product_id",
                    row_id: str = "review_id", weights=WEIGHTS, band=(IDEAL_MIN, IDEAL_MAX, HARD_MAX),
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Votes normalised within each product; also adds the product's row count as ``total_reviews``.

    Lengths come from the column ``tokens``, or are counted in the column ``text`` as ``review_token_count``: after the
    join, so that the per-product statistics never read the texts.
    """
    require_columns(df, [key, row_id, "helpful_vote", "verified_purchase", text or tokens])
    votes = F.coalesce(F.col("helpful_vote").cast("double"), F.lit(0.0))
    stats = df.groupBy(key).agg(
        F.min(votes).alias("_fewest"), F.max(votes).alias("_most"), F.count(F.lit(1)).alias("total_reviews")
    )
    joined = join_key_stats(df, stats, key, "total_reviews", F.col(row_id), hot_rows)
    if text:
        joined, tokens = with_values(joined, review_token_count=token_count(F.col(text))), "review_token_count"
    low, high = vote_log(F.col("_fewest")), vote_log(F.col("_most"))
    return _scored(joined, low, high, F.coalesce(F.col(tokens), F.lit(0)), weights, band).drop("_fewest", "_most")
