"""URL verdicts from listed prefixes and listed canonical URLs: a blocked Bloom filter passes possible hits to an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import BROADCAST_BYTES, bloom_filter, bloom_hits, salted_join, saved

# Query parameters that name no other page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host + path without scheme, ``www.`` or ``m.``, trailing slashes and fragment, plus the sorted query without tracking
    parameters; null without ``://``."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow", listed_verdict: str = "block", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains when the path starts with its path, and the
    longest (host and path together, then the longer host) wins; ``rule`` is its host and path. Without a fitting rule, a page
    whose canonical URL is in ``listed`` (url, any spelling) gets ``listed_verdict``, any other page ``default``.

    Each page names the keys that could be listed: its canonical URL, and for each shape of a rule (labels of the host, length
    of the path) its own last labels and leading path. The filter of all listed keys drops nearly all; the rest meet the list in
    a join on the key, salted where one key is hit by many pages. A null url or one without ``://`` has no host or path and gets
    ``default``; null ids stay null; repeated rows repeat; empty tables work; rules with a null and null listed urls are ignored.
    """
    spread = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.monotonically_increasing_id().alias("row"))
    base = saved(spread, "urls")
    ruled = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat(F.lit("rule "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("host").alias("host_length"), F.length("path").alias("path_length"))
    shapes = ruled.agg(F.collect_set(F.struct("labels", "path_length"))).scalar()
    by_url = listed.select(F.concat(F.lit("url "), canonical_url(F.col("url"))).alias("key")).where("key IS NOT NULL").distinct()
    entries = saved(ruled.select("key", "rule", "verdict", "host_length").dropDuplicates(["key", "verdict"]).unionByName(
        by_url.select("key", F.lit(None).cast("string").alias("rule"), F.lit(listed_verdict).alias("verdict"), F.lit(0).alias("host_length"))), "listed")
    keys = entries.count()
    total = base.count()

    split = base.select("row", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("canonical"),
                        F.coalesce(shapes, F.array().cast("array<struct<labels:int,path_length:int>>")).alias("shapes"))
    labels = F.split("host", r"\.")
    fitting = F.filter("shapes", lambda s: (F.size(labels) >= s["labels"]) & (F.length("path") >= s["path_length"]) & (F.col("host") != ""))
    by_rule = F.transform(fitting, lambda s: F.concat(
        F.lit("rule "), F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["path_length"])))
    named = split.select("row", F.explode(F.array_distinct(F.array_append(by_rule, F.concat(F.lit("url "), F.col("canonical"))))).alias("key"))
    possible = bloom_hits(named, F.col("key"), bloom_filter(entries, F.col("key"), keys), keys, "maybe", broadcast_bytes).where("maybe").drop("maybe")
    counted = possible.groupBy("key").count().join(
        entries.groupBy("key").agg(F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict")).alias("entry")), "key")
    found = salted_join(possible, counted, "key", "count", F.col("row"), total).groupBy("row").agg(
        F.max(F.when(F.col("entry.rule").isNotNull(), F.col("entry"))).alias("best"),
        F.max(F.when(F.col("entry.rule").isNull(), F.col("entry.verdict"))).alias("named"))
    return base.join(found, "row", "left").select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", "named", F.lit(default)).alias("verdict"), F.col("named").isNotNull().alias("listed"))
