"""Fixed schemas of the tables this library reads and writes, and plan-time column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()),
}


def struct_of(columns: str) -> T.StructType:
    """``"a string, b bigint"`` as a struct type, without needing a session yet."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The three labels and the places a label can come from.
SENTIMENTS = ("positive", "neutral", "negative")
SENTIMENT_SOURCES = ("precomputed", "rating", "model", "fallback")
MODEL_LABELS = ("negative", "neutral", "positive")

RAW_REVIEWS = struct_of(
    "product_id string, rating double, review_title string, review_text string, timestamp bigint, "
    "helpful_vote bigint, verified_purchase boolean, images string"
)
RAW_META = struct_of(
    "product_id string, product_title string, average_rating double, rating_number bigint, price double, "
    "store string, main_category string, categories string, features string, description string, "
    "images string, details string"
)
# The source files are loosely typed: every scalar is read as text and coerced afterwards. Nested
# values arrive as their JSON text because the declared type is string.
SOURCE_REVIEWS_JSON = struct_of(
    "parent_asin string, rating string, title string, text string, timestamp string, helpful_vote string, "
    "verified_purchase string, images string"
)
SOURCE_META_JSON = struct_of(
    "parent_asin string, title string, average_rating string, rating_number string, price string, store string, "
    "main_category string, categories string, features string, description string, images string, details string"
)
META_COLUMNS = ("product_title", "average_rating", "rating_number", "price", "store", "main_category")
MESSAGE = T.ArrayType(struct_of("role string, content string"))
MESSAGES = T.StructType([T.StructField("messages", MESSAGE)])
REVIEW_ITEM = struct_of(
    "review_id string, review_title string, review_text string, text string, rating double, timestamp bigint, "
    "helpful_vote bigint, verified_purchase int, text_len int, review_quality_score double, "
    "helpful_vote_norm double, length_score double"
)
CHAT_DATASET = struct_of(
    "product_id string, product_title string, main_category string, sentiment string, source_reviews strings, "
    "source_review_count int, original_sentiment_count int, prompt_hash string, prompt string, "
    "gold_summary string, generator_provider string, generator_model string"
)
CHAT_ERRORS = struct_of(
    "product_id string, product_title string, main_category string, sentiment string, source_review_count int, "
    "prompt_hash string, error string, generator_provider string, generator_model string"
)
SUMMARY_PREDICTIONS = struct_of(
    "prompt string, reference_answer string, generated_answer string, latency_ms double"
).add("messages", MESSAGE)
CATALOG_COLUMNS = (
    "product_id", "product_title", "store", "main_category", "price", "average_rating", "rating_number",
    "review_count", "avg_review_rating", "verified_review_count", "total_helpful_votes", "latest_review_ts",
    "image_url", "categories_list", "features_text", "description_text", "search_text",
)
CARD_COLUMNS = (
    "product_id", "product_title", "store", "main_category", "price", "average_rating", "rating_number",
    "review_count", "image_url",
)
REVIEWS_INDEX_COLUMNS = (
    "review_id", "product_id", "review_title", "review_text", "review_char_len", "timestamp", "rating",
    "review_datetime", "helpful_vote", "verified_purchase", "has_review_image",
)
REVIEW_REQUIRED = (
    "product_id", "rating", "review_title", "review_text", "timestamp", "helpful_vote", "verified_purchase",
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Fail while the plan is built, before any job, when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    """The column when the frame has it, else the default."""
    return F.col(name) if name in df.columns else default


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to exactly ``schema``: its columns, order and types; absent columns become NULL."""
    return df.select(
        *[column_or(df, f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
