"""The product catalog: build, search, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.coerce import bool_column, int_column, number_column
from shelfsense.functions.lists import first_image, join_list, parse_list
from shelfsense.functions.text import blank_to_null, strip
from shelfsense.operators.dedupe import all_columns, keep_first
from shelfsense.schemas import CARD_COLUMNS, CATALOG_COLUMNS, column_or

# The columns a search looks at.
SEARCH_COLUMNS = ("product_id", "product_title", "store", "main_category", "search_text")


def review_totals(reviews: DataFrame) -> DataFrame:
    """Per product: reviews, mean rating, verified reviews, votes, latest time. Partial sums before the shuffle."""
    kept = reviews.where(strip(F.col("product_id").cast("string")) != "")
    return kept.groupBy(strip(F.col("product_id").cast("string")).alias("product_id")).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg(number_column(reviews, "rating")).alias("avg_review_rating"),
        F.count_if(F.coalesce(bool_column(reviews, "verified_purchase"), F.lit(False))).alias("verified_review_count"),
        F.sum(F.coalesce(int_column(reviews, "helpful_vote"), F.lit(0))).alias("total_helpful_votes"),
        F.max(int_column(reviews, "timestamp")).alias("latest_review_ts"),
    )


def search_text(*parts: Column) -> Column:
    """All parts in lower case, blank parts keeping their separator."""
    return F.lower(strip(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])))


def build_catalog(meta: DataFrame, reviews: DataFrame, order: list[Column | str] | None = None, sort: bool = True) -> DataFrame:
    """Metadata of reviewed products with their review totals, most reviewed first."""
    meta = meta.where(strip(F.col("product_id").cast("string")) != "").withColumn(
        "product_id", strip(F.col("product_id").cast("string"))
    )
    one = keep_first(meta, ["product_id"], order or all_columns(meta))
    null = F.lit(None).cast("string")
    joined = one.join(review_totals(reviews), "product_id")
    out = (
        joined.withColumn("product_title", blank_to_null(F.col("product_title")))
        .withColumn("store", blank_to_null(F.col("store")))
        .withColumn("main_category", blank_to_null(F.col("main_category")))
        .withColumn("price", blank_to_null(F.col("price").cast("string")))
        .withColumn("average_rating", number_column(joined, "average_rating"))
        .withColumn("rating_number", F.coalesce(int_column(joined, "rating_number"), F.lit(0)))
        .withColumn("avg_review_rating", F.coalesce("avg_review_rating", F.lit(0.0)))
        .withColumn("categories_list", parse_list(column_or(joined, "categories", null)))
        .withColumn("features_text", join_list(column_or(joined, "features", null)))
        .withColumn("description_text", join_list(column_or(joined, "description", null)))
        .withColumn("image_url", first_image(column_or(joined, "images", null)))
        .withColumn(
            "search_text",
            search_text(
                F.col("product_title"), F.col("store"), F.col("main_category"),
                F.array_join("categories_list", " "), F.col("features_text"), F.col("description_text"),
            ),
        )
        .select(*CATALOG_COLUMNS)
    )
    if sort:
        out = out.orderBy(F.desc("review_count"), F.desc("rating_number"), F.desc_nulls_last("average_rating"), "product_id")
    return out


def search(catalog: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive substring over the search columns; % and _ of the query act as wildcards."""
    if not query:
        return catalog
    pattern = f"%{query}%"
    match = F.lit(False)
    for name in SEARCH_COLUMNS:
        if name in catalog.columns:
            match = match | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return catalog.where(match)


def search_count(catalog: DataFrame, query: str | None = None) -> DataFrame:
    return search(catalog, query).agg(F.count(F.lit(1)).alias("total"))


def page(catalog: DataFrame, query: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in id order; the limit stays within 1..100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be in 1..100 and offset not negative")
    return search(catalog, query).orderBy("product_id").offset(offset).limit(limit)


def cards(catalog: DataFrame) -> DataFrame:
    """The short form of a product."""
    return catalog.select(*[
        F.coalesce("product_title", F.lit("")).alias(c) if c == "product_title" else F.col(c) for c in CARD_COLUMNS
    ])


def product(catalog: DataFrame, product_id: str) -> DataFrame:
    return catalog.where(F.col("product_id") == product_id)


def popular(reviews: DataFrame, min_reviews: int, k: int, key: str = "product_id") -> DataFrame:
    """The ``k`` most reviewed products with at least ``min_reviews`` reviews."""
    counts = reviews.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("review_count"))
    return counts.where(F.col("review_count") >= min_reviews).orderBy(F.desc("review_count"), key).limit(k)


def product_info(catalog: DataFrame) -> DataFrame:
    """Catalog rows with defaults for missing values, as an insight reports them."""
    blank = ("product_title", "store", "main_category", "price", "image_url", "features_text", "description_text", "search_text")
    zero = ("rating_number", "review_count", "verified_review_count", "total_helpful_votes")
    columns = []
    for name in CATALOG_COLUMNS:
        value = F.col(name)
        if name in blank:
            value = F.coalesce(strip(value), F.lit(""))
        elif name in zero:
            value = F.coalesce(value, F.lit(0))
        elif name == "avg_review_rating":
            value = F.coalesce(value, F.lit(0.0))
        elif name == "categories_list":
            value = F.coalesce(value, F.array().cast("array<string>"))
        columns.append(value.alias(name))
    return catalog.select(*columns)
