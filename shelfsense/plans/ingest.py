"""Loosely typed source records to typed reviews and product metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.coerce import to_bool, to_float, to_int
from shelfsense.functions.text import strip
from shelfsense.operators.dedupe import keep_first
from shelfsense.schemas import RAW_META, RAW_REVIEWS, cast_to


def valid_review(product_id: Column, rating: Column, text: Column) -> Column:
    """Id and text present and not blank, rating a number."""
    return F.coalesce((strip(product_id) != "") & (strip(text) != "") & to_float(rating).isNotNull(), F.lit(False))


def typed_reviews(source: DataFrame) -> DataFrame:
    """Valid source reviews under their canonical names and types."""
    kept = source.where(valid_review(F.col("parent_asin"), F.col("rating"), F.col("text")))
    return cast_to(
        kept.select(
            strip(F.col("parent_asin")).alias("product_id"),
            to_float(F.col("rating")).alias("rating"),
            F.col("title").alias("review_title"),
            strip(F.col("text")).alias("review_text"),
            to_int(F.col("timestamp")).alias("timestamp"),
            to_int(F.col("helpful_vote")).alias("helpful_vote"),
            to_bool(F.col("verified_purchase"), numeric=True).alias("verified_purchase"),
            F.col("images"),
        ),
        RAW_REVIEWS,
    )


def typed_meta(source: DataFrame) -> DataFrame:
    """Source metadata with a non-blank id under its canonical names and types."""
    return cast_to(
        source.where(strip(F.col("parent_asin")) != "").select(
            strip(F.col("parent_asin")).alias("product_id"),
            F.col("title").alias("product_title"),
            to_float(F.col("average_rating")).alias("average_rating"),
            to_int(F.col("rating_number")).alias("rating_number"),
            to_float(F.col("price")).alias("price"),
            "store", "main_category", "categories", "features", "description", "images", "details",
        ),
        RAW_META,
    )


def product_ids(reviews: DataFrame, key: str = "product_id") -> DataFrame:
    """The distinct non-blank ids."""
    return reviews.where(strip(F.col(key).cast("string")) != "").select(key).distinct()


def matching_meta(meta: DataFrame, reviews: DataFrame, order: list[Column | str], key: str = "product_id") -> DataFrame:
    """The first metadata row of every reviewed product."""
    return keep_first(meta.join(product_ids(reviews, key), key, "left_semi"), [key], order)


def products_without_meta(reviews: DataFrame, meta: DataFrame, key: str = "product_id") -> DataFrame:
    return product_ids(reviews, key).join(meta.select(key), key, "left_anti")


def _order_number(df: DataFrame, first: str) -> Column | None:
    """A number that ascends with a text column: its six bytes after what all of its values begin with. Values that agree in them tie."""
    ends = df.agg(F.min(first).alias("low"), F.max(first).alias("high")).first()
    if ends["low"] is None:
        return None
    low, high = ends["low"].encode(), ends["high"].encode()
    same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    held = F.rpad(F.hex(F.substring(F.encode(F.col(first), "utf-8"), same + 1, 6)), 12, "0")
    # Texts shorter than that come before their continuations; nulls before all.
    return F.coalesce(F.conv(held, 16, 10).cast("bigint"), F.lit(-1))


def leading_rows(df: DataFrame, order: list[Column | str], n: int, bins: int = 10_000) -> DataFrame:
    """The first ``n`` rows in ``order``. Where the first order column is a number or a text, a sketch of it bounds the value that the n-th row
    can have, and rows beyond it stay in their tasks; the rest ends in one task, so it holds little more than ``n`` rows, but for ties."""
    first = order[0] if isinstance(order[0], str) else None
    kind = df.schema[first].dataType if first is not None else None
    value = None
    if isinstance(kind, T.NumericType):
        value = F.when(F.col(first).isNotNull(), F.col(first)).otherwise(F.lit(float("-inf")))
    elif isinstance(kind, T.StringType):
        value = _order_number(df, first)
    if value is not None:
        facts = df.select(value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [i / 100 for i in range(1, 101)], bins).alias("cuts")).first()
        if facts["n"] > 2 * n:
            at = min(99, int(100 * (n / facts["n"] + 2 / bins)) + 1)
            near = df.where(value <= facts["cuts"][at])
            if near.limit(n).count() >= n:
                df = near
    return df.orderBy(*order).limit(n)


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in source order; fewer available rows are an error. Counts up to ``n`` rows."""
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"only {found} valid rows, {n} requested")
    return leading_rows(df, order, n)


def ingest_counts(source: DataFrame) -> DataFrame:
    """Scanned and valid rows and distinct products in one pass."""
    valid = valid_review(F.col("parent_asin"), F.col("rating"), F.col("text"))
    return source.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(valid).alias("valid"),
        F.countDistinct(F.when(valid, strip(F.col("parent_asin")))).alias("products"),
    )
