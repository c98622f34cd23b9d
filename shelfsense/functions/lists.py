"""List-valued and image fields that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsense.functions.text import strip

# Image keys in order of preference.
IMAGE_KEYS = ("large", "hi_res", "thumb", "url", "image_url")

_HTTP = "^https?://"
# Lists inside lists are followed this deep.
_DEPTH = 3
_TOKENS = r""" "(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^"']+|["'] """.strip()


def _literal_as_json(text: Column) -> Column:
    """A Python list or dict literal as JSON text: single-quoted strings become double-quoted, None, True and False change
    spelling outside strings, and a comma before a closing bracket goes."""
    def token(t: Column) -> Column:
        inner = F.replace(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        other = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        return (F.when(t.startswith("'") & (F.length(t) > 1), F.concat(F.lit('"'), inner, F.lit('"')))
                .when(t.startswith('"'), t).otherwise(F.regexp_replace(other, r",\s*([\]}])", "$1")))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), token), "")


def _json(text: Column) -> Column:
    """The whole text as one JSON value. The parser would stop after a first value; as a member of an object, what follows is an error."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant")


def _parsed(text: Column) -> Column:
    """The whole text as JSON, or else as a literal; NULL when it is neither to its end."""
    return F.coalesce(_json(text), _json(F.when(text.rlike(r"^[\[{'\"]"), _literal_as_json(text))))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _item_text(item: Column) -> Column:
    """A list item as text, spelt as Python spells it."""
    kind = _kind(item)
    return (F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(item, "$", "string")))
            .otherwise(F.try_variant_get(item, "$", "string")))


def _clean_items(items: Column) -> Column:
    trimmed = F.transform(items, strip)
    return F.filter(trimmed, lambda x: F.coalesce(x != "", F.lit(False)))


def parse_list(value: Column) -> Column:
    """Items of a text that is a JSON list or a list literal to its end; other text is a one-item list; NULL is empty."""
    text = strip(value)
    parsed = F.when(text.startswith("["), _parsed(text))
    listed = F.when(_kind(parsed).startswith("ARRAY"), F.transform(F.try_variant_get(parsed, "$", "array<variant>"), _item_text))
    items = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(text)))
    return _clean_items(items)


def join_list(value: Column) -> Column:
    return F.nullif(F.array_join(parse_list(value), " | "), F.lit(""))


def _http(text: Column) -> Column:
    clean = strip(text)
    return F.when(clean.rlike(_HTTP), clean)


def _image(value: Column, depth: int = _DEPTH) -> Column:
    """A URL, the best key of an object, or the first image of a list's items in order."""
    kind = _kind(value)

    def key(name: str) -> Column:
        found = F.try_variant_get(value, f"$.{name}", "string")
        return F.when(~found.isin("", "false", "0"), found)

    out = F.when(kind == "STRING", _http(F.try_variant_get(value, "$", "string"))).when(kind.startswith("OBJECT"), F.coalesce(*[key(k) for k in IMAGE_KEYS]))
    if depth:
        found = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _image(x, depth - 1))
        out = out.when(kind.startswith("ARRAY"), F.get(F.filter(found, lambda u: u.isNotNull()), F.lit(0)))
    return out


def first_image(value: Column) -> Column:
    """First usable image: a URL, the best key of an object, or the first item of a list, in order, that gives one."""
    text = strip(value)
    return F.when(text.rlike(_HTTP), text).otherwise(_image(_parsed(text)))


def leading_image(value: Column) -> Column:
    """Display rule: the text itself, or the first list item, and only when it is an http(s) address."""
    text = strip(value)
    head = F.get(F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")), F.lit(0))
    return F.coalesce(_http(head), F.when(text.rlike(_HTTP), text))
