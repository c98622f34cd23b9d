"""Substring search of the catalog through posting lists of three-letter sequences; the exact pattern decides among the candidates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.plans.catalog import SEARCH_COLUMNS, search
from shelfsense.sources.lookup import LISTED_KEYS, read_all, read_keys, write_lookup

NUMBER = "_n"
# Row numbers that share a posting list: no list is longer, however common its letters are.
LIST_SPAN = 32_768
# Sequences of a query that are looked up; all of a longer query's would only repeat what these say.
MOST_GRAMS = 24


def _grams(text) -> F.Column:
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3)))).otherwise(F.array())


def build_search_index(catalog: DataFrame, root: str, key: str = "product_id") -> None:
    """Write ``root/rows``, the catalog by id with a row number, and ``root/grams``: for each sequence of three lower-case characters of a searched
    column the numbers of the rows that have it, in lists of at most ``LIST_SPAN``."""
    write_lookup(catalog, f"{root}/rows", key, number=NUMBER)
    rows = read_all(catalog.sparkSession, f"{root}/rows")
    fields = [F.coalesce(_grams(F.lower(c)), F.array()) for c in SEARCH_COLUMNS if c in catalog.columns]
    each = rows.select(NUMBER, F.explode(F.array_distinct(F.concat(*fields))).alias("gram"), F.floor(F.col(NUMBER) / LIST_SPAN).alias("span"))
    lists = each.groupBy("gram", "span").agg(F.array_sort(F.collect_list(NUMBER)).alias("numbers"))
    write_lookup(lists, f"{root}/grams", "gram", distinct_keys=200_000)


def query_grams(spark: SparkSession, query: str) -> list[str] | None:
    """What every match must hold; None where the index cannot help: no three literal characters in a row, or an escape."""
    if "\\" in query:
        return None
    lowered = spark.range(1).select(F.lower(F.lit(query))).first()[0]
    grams = list(dict.fromkeys(part[i:i + 3] for part in re.split("[%_]", lowered) for i in range(len(part) - 2)))
    return grams[:MOST_GRAMS] or None


def candidates(spark: SparkSession, root: str, grams: list[str]) -> DataFrame:
    """Numbers of the rows that have all of ``grams``: the lists of each span are intersected, a span that lacks one is out."""
    lists = read_keys(spark, f"{root}/grams", "gram", grams)
    spans = lists.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.size("numbers").alias("size"), "numbers"))).alias("lists"))
    # The shortest list first.
    shared = F.aggregate(F.slice("lists", 2, len(grams)), F.col("lists")[0]["numbers"], lambda held, more: F.array_intersect(held, more["numbers"]))
    return spans.where(F.col("n") == len(grams)).select(F.explode(shared).alias(NUMBER))


def search_indexed(spark: SparkSession, root: str, query: str | None) -> DataFrame:
    """The rows that ``catalog.search`` gives. Few candidates are read by number; many, or a query without three literal characters in a row, by a
    join or a scan."""
    rows = read_all(spark, f"{root}/rows")
    grams = query_grams(spark, query) if query else None
    if grams is None:
        return search(rows, query).drop(NUMBER)
    found = candidates(spark, root, grams)
    few = [r[0] for r in found.limit(LISTED_KEYS + 1).collect()]
    if len(few) > LISTED_KEYS:
        return search(rows.join(found, NUMBER, "left_semi"), query).drop(NUMBER)
    if not few:
        return rows.where(F.lit(False)).drop(NUMBER)
    return search(rows.where(F.col(NUMBER).between(min(few), max(few)) & F.col(NUMBER).isin(few)), query).drop(NUMBER)
