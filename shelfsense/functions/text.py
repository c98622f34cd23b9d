"""Text cleaning as column expressions; the one Python step decodes HTML entities."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Unicode counts as white space, the ASCII punctuation that cleaning
# removes (all but ? and !), and the tag pattern.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)
REMOVED_PUNCTUATION = "\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"
TAG = r"<[^>]+>"
# A character reference that a semicolon ends.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")

_PUNCTUATION = r"[\"-/:->@\[-`{-~]+"
_SPACES = "[\t-\r\x1c-\x20\x85\xa0  -     　]+"
# The same for ASCII text: a class of low characters only is a table look-up in the regex engine.
_ASCII_SPACES = "[\t-\r\x1c-\x20]+"


def is_ascii(value: Column) -> Column:
    return F.length(value) == F.octet_length(value)


def strip(value: Column) -> Column:
    """Trim every kind of white space, not just the space character."""
    return F.btrim(value, F.lit(WHITESPACE))


def collapse(value: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    plain = F.regexp_replace(value, _ASCII_SPACES, " ")
    return F.btrim(F.when(is_ascii(value), plain).otherwise(F.regexp_replace(value, _SPACES, " ")))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value.cast("string")), F.lit(""))


def null_to_blank(value: Column) -> Column:
    return F.coalesce(strip(value.cast("string")), F.lit(""))


@F.pandas_udf(T.StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def _closed_reference(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" or found[0][1:] in html5 else found[0]


@F.pandas_udf(T.StringType())
def _decode_closed_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _CLOSED.sub(_closed_reference, t), na_action="ignore")


def decode_entities(value: Column, closed: bool = False) -> Column:
    """Only texts that hold an ampersand carry a payload to Python and back. With ``closed``, only references that a semicolon ends are decoded;
    else also the old names that browsers read without one (``&amp`` at the end of a cut text)."""
    decode = _decode_closed_entities if closed else _decode_entities
    return F.coalesce(decode(F.when(F.contains(value, F.lit("&")), value)), value)


def clean_review_text(value: Column, entities: bool = True, closed: bool = False) -> Column:
    """Entities decoded, tags to spaces, punctuation but ?! removed, ?! set apart, white space collapsed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if entities:
        text = decode_entities(text, closed)
    text = F.regexp_replace(text, TAG, " ")
    text = F.regexp_replace(text, _PUNCTUATION, "")
    return collapse(F.regexp_replace(text, "([!?])", " $1 "))


def model_text(clean_title: Column, clean_body: Column) -> Column:
    """Lower-case title and body, the title left out when blank; both sides already cleaned."""
    return collapse(F.lower(F.concat_ws(" ", F.nullif(clean_title, F.lit("")), clean_body)))


def token_count(value: Column) -> Column:
    text = null_to_blank(value)
    tokens = F.when(is_ascii(text), F.size(F.split(text, _ASCII_SPACES))).otherwise(F.size(F.split(text, _SPACES)))
    return F.when(text == "", 0).otherwise(tokens)


def snippet(value: Column, limit: int = 220) -> Column:
    text = null_to_blank(value)
    head = F.rtrim(F.substring(text, 1, limit - 3), F.lit(WHITESPACE))
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def distinct_texts(texts: Column) -> Column:
    """Collapse, drop blanks, keep the first of each text ignoring case, order and case kept."""
    cleaned = F.filter(F.transform(texts, collapse), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(
            F.array_append(kept, t)
        ),
    )
