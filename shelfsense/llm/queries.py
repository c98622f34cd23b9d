"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm import (bpe, exact_dedup, factor_machine, hard_negatives, hilbert_ann, html_text, jaccard_join, lexical_search, line_dedup, mixing,
                            secret_scan, url_filter)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_hilbert_ann(spark, sf):
    return hilbert_ann.nearest(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_secret_scan(spark, sf):
    return secret_scan.scan(_table(spark, sf, "documents"), vocabulary_path())


# The rules of the query, and words that mark a host as an advertiser's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_HOSTS = r"casino|poker|pills|betting|loans"


@query
def op3_url_filter(spark, sf):
    """The list holds the canonical URLs of pages on advertisers' hosts."""
    pages = _table(spark, sf, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = pages.where(url_filter.url_host(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge_urls(pages, rules, listed)


ORACLES["op3_url_filter"] = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
    SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, RULES))}
), fit AS (
    SELECT page_id, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
    FROM cut JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{LISTED_HOSTS}') THEN 'block' ELSE 'allow' END) AS verdict,
       regexp_matches(host, '{LISTED_HOSTS}') AS listed
FROM cut LEFT JOIN (FROM fit WHERE place = 1) USING (page_id)
"""


@query
def op4_line_dedup(spark, sf):
    return line_dedup.repeated_lines(_table(spark, sf, "documents"), whole=True)


@query
def op5_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(_table(spark, sf, "documents"))


ORACLES["op5_exact_dedup"] = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@query
def op6_ngram_jaccard(spark, sf):
    return jaccard_join.jaccard_components(_table(spark, sf, "documents"), n=3, num=90, den=100)


@query
def op7_source_mix(spark, sf):
    return mixing.mix(_table(spark, sf, "documents"))


@query
def op8_token_counts(spark, sf):
    return bpe.token_counts(_table(spark, sf, "documents"), vocabulary_path())


@query
def op9_bpe_codec(spark, sf):
    return bpe.encoding_digests(bpe.encode_documents(_table(spark, sf, "documents"), vocabulary_path()))


@query
def op10_quality_classifier(spark, sf):
    docs = _table(spark, sf, "documents")
    machine = factor_machine.fit_quality(docs, _table(spark, sf, "labels"))
    scored = factor_machine.quality_scores(docs, machine)
    return scored.select("doc_id", factor_machine.held_out_fold().alias("held_out"), "score", "predicted")


@query
def op11_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op11_hard_negatives"] = """
WITH rows AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same,
           CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v)::BIGINT END AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT r, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.r = n.r AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.r, p.positive ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op12_lexical_search(spark, sf):
    return lexical_search.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), facts AS (
    SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), postings AS (
    SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf FROM docs, unnest(terms) AS t(term) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, facts GROUP BY term, n_docs
), wanted AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), scored AS (
    SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN postings USING (term), facts GROUP BY ALL
)
SELECT item_id, row_number() OVER w::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER w <= 20
"""


@query
def op13_html_text(spark, sf):
    return html_text.main_texts(_table(spark, sf, "pages"))
