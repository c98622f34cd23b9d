"""The serving table of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.coerce import bool_column, int_column, millis_to_datetime, number_column
from shelfsense.functions.ids import index_review_id
from shelfsense.functions.text import blank_to_null, strip
from shelfsense.operators.dedupe import keep_first
from shelfsense.operators.skew import dense_ordinal
from shelfsense.schemas import REVIEWS_INDEX_COLUMNS, column_or, require_columns


def build_index(reviews: DataFrame, position: str = "position", strict_images: bool = False, sort: bool = True,
                ordinal: str | None = None) -> DataFrame:
    """Usable reviews, numbered in source order, first of each (product, text, time) kept.

    ``position`` is a unique long giving the source order; gaps are fine. An image field holding an empty list counts as
    an image unless ``strict_images``. ``ordinal`` names a column that numbers the usable rows already (``number_in_file_order``); then no row
    moves to be numbered.
    """
    require_columns(reviews, ["product_id", "rating", "review_text", position], "reviews")
    none = F.lit(None).cast("string")
    images = strip(column_or(reviews, "images", none))
    has_image = F.coalesce(images != "", F.lit(False))
    if strict_images:
        has_image = has_image & F.coalesce(F.regexp_replace(images, r"\s", "") != "[]", F.lit(True))
    usable = (
        reviews.select(
            F.col(position).cast("bigint").alias("_position"),
            F.col("product_id").cast("string").alias("product_id"),
            blank_to_null(column_or(reviews, "review_title", none)).alias("review_title"),
            blank_to_null(F.col("review_text")).alias("review_text"),
            (int_column(reviews, "timestamp") if "timestamp" in reviews.columns else none.cast("bigint")).alias("timestamp"),
            number_column(reviews, "rating").alias("rating"),
            (F.coalesce(int_column(reviews, "helpful_vote"), F.lit(0)) if "helpful_vote" in reviews.columns else F.lit(0).cast("bigint"))
            .alias("helpful_vote"),
            (F.coalesce(bool_column(reviews, "verified_purchase"), F.lit(False)) if "verified_purchase" in reviews.columns else F.lit(False))
            .alias("verified_purchase"),
            has_image.alias("has_review_image"),
            *([F.col(ordinal).alias("_ordinal")] if ordinal else []),
        )
        .where(F.col("product_id").isNotNull() & (F.col("product_id") != "") & F.col("review_text").isNotNull())
    )
    numbered = usable if ordinal else dense_ordinal(usable, "_position", "_ordinal")
    first = keep_first(numbered, ["product_id", "review_text", "timestamp"], ["_ordinal"])
    out = (
        first.withColumn("review_id", index_review_id(F.col("_ordinal")))
        .withColumn("review_char_len", F.length("review_text"))
        .withColumn("review_datetime", millis_to_datetime(F.col("timestamp")))
    )
    if sort:
        out = out.orderBy("product_id", F.desc("helpful_vote"), F.desc_nulls_last("timestamp"), "_ordinal")
    return out.select(*REVIEWS_INDEX_COLUMNS)


def serving_rows(index: DataFrame) -> DataFrame:
    """Index rows with defaults for missing values, as the insight stage takes them."""
    empty = F.lit("")
    text = F.coalesce("review_text", empty)
    length = F.col("review_char_len")
    return index.select(
        "review_id", "product_id",
        F.coalesce(column_or(index, "review_title", F.lit(None).cast("string")), empty).alias("review_title"),
        text.alias("review_text"),
        F.when(length != 0, length).otherwise(F.length(text)).alias("review_char_len"),
        "timestamp", "review_datetime",
        F.coalesce("helpful_vote", F.lit(0)).alias("helpful_vote"),
        F.coalesce("verified_purchase", F.lit(False)).alias("verified_purchase"),
        F.coalesce(column_or(index, "has_review_image", F.lit(None).cast("boolean")), F.lit(False)).alias("has_review_image"),
        "rating",
        column_or(index, "predicted_sentiment", F.lit(None).cast("string")).alias("predicted_sentiment"),
        column_or(index, "sentiment_confidence", F.lit(None).cast("double")).alias("sentiment_confidence"),
    )
