"""Identifiers derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def review_hash(product_id: Column, rating: Column, timestamp: Column, review_text: Column) -> Column:
    """md5 over the four fields; the rating as double text, the timestamp as whole milliseconds."""
    return F.md5(
        F.concat_ws("||", _text(product_id), _text(rating.cast("double")), _text(timestamp.cast("bigint")),
                    _text(review_text))
    )


def load_review_id(review_id: Column, product_id: Column, ordinal: Column, review_text: Column) -> Column:
    """The given id, or a hash of product, row ordinal and the text's first 100 characters when blank."""
    derived = F.md5(F.concat_ws("|", _text(product_id), _text(ordinal), F.substring(_text(review_text), 1, 100)))
    return F.coalesce(F.nullif(F.btrim(review_id), F.lit("")), derived)


def index_review_id(ordinal: Column) -> Column:
    return F.concat(F.lit("rvw_"), ordinal.cast("bigint").cast("string"))


def prompt_hash(prompt: Column) -> Column:
    return F.sha1(prompt)


def request_key(product_id: Column, sentiment: Column) -> Column:
    return F.concat_ws("||", product_id, sentiment)


def insight_key(product_id: Column, model_version: Column) -> Column:
    return F.concat_ws(":", F.lit("product_insight"), product_id, model_version)


def file_safe(value: Column) -> Column:
    """Letters, digits, underscore and hyphen stay, all else becomes an underscore."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_")


def slug(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit(" "), F.lit("_"))
