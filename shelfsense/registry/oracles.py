"""The named queries as plain SQL, for checking results in another engine."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Pieces -------------------------------------------------------------------------------------------------

DOC_REVIEWS = """doc_reviews AS (
  SELECT d.doc_id AS position, 'd' || d.doc_id AS review_id, d.source AS product_id,
    CASE WHEN d.doc_id % 4 <> 0 THEN d.lang || ' review!' END AS review_title,
    d.text AS review_text, length(d.text) AS review_char_len,
    CAST(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 5.0 WHEN l.quality = 1 THEN 3.0
      WHEN l.quality = 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 2.5 ELSE 1.0 END END AS DOUBLE) AS rating,
    d.n_chars % 17 AS helpful_vote, d.doc_id % 3 <> 0 AS verified_purchase,
    CASE WHEN d.n_chars % 97 <> 0 THEN 1577836800000 + (d.n_chars % 1000) * 3600000 END AS "timestamp",
    CASE d.doc_id % 12 WHEN 0 THEN ' Negative ' WHEN 1 THEN 'neutral' WHEN 2 THEN 'great' END AS predicted_sentiment,
    CASE WHEN d.doc_id % 12 <= 2 THEN (d.n_chars % 150) / 100.0 END AS given_confidence,
    CASE d.doc_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN ' ' WHEN 2 THEN 'http://img/' || d.doc_id END AS images, d.lang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

FACT_REVIEWS = """fact_reviews AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST((l_linenumber - 1) % 5 + 1 AS DOUBLE) AS rating,
    CAST(l_quantity AS BIGINT) AS helpful_vote, l_returnflag = 'N' AS verified_purchase, epoch_ms(l_shipdate) AS "timestamp",
    CAST(trunc(l_extendedprice) AS BIGINT) % 400 AS text_len,
    CASE WHEN (l_linenumber - 1) % 5 + 1 >= 4 THEN 'positive' WHEN (l_linenumber - 1) % 5 + 1 = 3 THEN 'neutral' ELSE 'negative' END AS sentiment_label,
    *
  FROM lineitem)"""

PART_META = """part_meta AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey % 50 = 0 THEN '  ' ELSE ' ' || p_name END AS product_title,
    p_brand AS store, p_type AS main_category, CASE WHEN p_partkey % 9 <> 0 THEN '$' || p_partkey END AS price,
    CASE WHEN p_partkey % 7 <> 0 THEN (p_size % 50) / 10.0 END AS average_rating,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS rating_number, p_partkey, p_name, p_brand, p_type, p_size
  FROM part)"""

GROUP_REVIEWS = """group_reviews AS (
  SELECT review_id, product_id, review_text AS text, coalesce(rating, 4.0) AS rating, "timestamp", helpful_vote, verified_purchase,
    {tokens} AS text_len,
    CASE WHEN rating >= 4 OR rating IS NULL THEN 'positive' WHEN rating = 3 THEN 'neutral' ELSE 'negative' END AS sentiment_label,
    'Source ' || product_id AS product_title, CASE WHEN product_id <> 'src3' THEN 'Texts' END AS main_category
  FROM doc_reviews)"""


def _tokens(text: str) -> str:
    return f"CAST(CASE WHEN trim({text}, E' \\t\\n\\r') = '' THEN 0 ELSE len(regexp_split_to_array(trim({text}, E' \\t\\n\\r'), '\\s+')) END AS BIGINT)"


def _length_score(n: str) -> str:
    return (f"CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} < 20 THEN {n} / 20.0::DOUBLE WHEN {n} <= 100 THEN 1.0 WHEN {n} >= 300 THEN 0.2 "
            f"ELSE greatest(0.2, 1.0::DOUBLE - ({n} - 100) / 200.0::DOUBLE) END::DOUBLE")


def _quality(norm: str, verified: str, length: str) -> str:
    return f"(0.4::DOUBLE * {norm} + 0.3::DOUBLE * CAST({verified} AS INTEGER)::DOUBLE + 0.3::DOUBLE * {length}) / 1.0::DOUBLE"


def _norm(low: str, high: str) -> str:
    return f"CASE WHEN {high} > {low} THEN (ln(1 + helpful_vote::DOUBLE) - {low}) / ({high} - {low}) ELSE 0.0 END::DOUBLE"


GROUPS = GROUP_REVIEWS.replace("{tokens}", _tokens("review_text"))


def _routed(limit: int = 100, source: str = "doc_reviews") -> str:
    return f"""counted AS (SELECT *, {_tokens('review_text')} AS tokens FROM {source}),
ranged AS (SELECT *, min(ln(1 + helpful_vote::DOUBLE)) OVER p AS lo, max(ln(1 + helpful_vote::DOUBLE)) OVER p AS hi,
    count(*) OVER p AS total_reviews FROM counted WINDOW p AS (PARTITION BY product_id)),
scored AS (SELECT *, {_quality(_norm('lo', 'hi'), 'verified_purchase', _length_score('tokens'))} AS q FROM ranged),
selected AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY q DESC, helpful_vote DESC,
    verified_purchase DESC, review_char_len DESC, "timestamp" DESC NULLS LAST, review_id) <= {limit}),
{ROUTE.replace('{source}', 'selected')}"""


ROUTE = """labelled AS (SELECT *, CASE WHEN lower(trim(predicted_sentiment)) IN ('positive', 'neutral', 'negative') THEN lower(trim(predicted_sentiment)) END AS given,
    CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' WHEN rating <= 2 THEN 'negative' END AS rated FROM {source}),
routed AS (SELECT *, coalesce(given, rated, 'positive') AS sentiment_label,
    CASE WHEN given IS NOT NULL THEN greatest(0.0, least(1.0, coalesce(given_confidence, 1.0))) ELSE 1.0 END::DOUBLE AS sentiment_confidence,
    CASE WHEN given IS NOT NULL THEN 'precomputed' WHEN rated IS NOT NULL THEN 'rating' ELSE 'model' END AS sentiment_source FROM labelled)"""

DISTRIBUTION = """SELECT product_id, count(*) FILTER (sentiment_label = 'positive') AS positive_count,
  count(*) FILTER (sentiment_label = 'neutral') AS neutral_count, count(*) FILTER (sentiment_label = 'negative') AS negative_count,
  count(*) AS total, round(count(*) FILTER (sentiment_label = 'positive') / count(*)::DOUBLE, 4) AS positive_ratio,
  round(count(*) FILTER (sentiment_label = 'neutral') / count(*)::DOUBLE, 4) AS neutral_ratio,
  round(count(*) FILTER (sentiment_label = 'negative') / count(*)::DOUBLE, 4) AS negative_ratio,
  count(*) FILTER (sentiment_source = 'precomputed') AS precomputed_source, count(*) FILTER (sentiment_source = 'rating') AS rating_source,
  count(*) FILTER (sentiment_source = 'model') AS model_source, 0::BIGINT AS fallback_source"""

PICKED = """picked AS (SELECT *, row_number() OVER (PARTITION BY product_id, sentiment_label ORDER BY q DESC, sentiment_confidence DESC,
    helpful_vote DESC, "timestamp" DESC NULLS LAST, review_id) AS rank FROM routed)"""

DOC_META = """doc_meta AS (SELECT source AS product_id, 'Source ' || source AS product_title, 'library' AS store, min(lang) AS main_category,
    count(*) AS rating_number FROM documents GROUP BY source)"""

_STRIP = "E' \\t\\n\\r'"


def _clean(text: str) -> str:
    punct = "\"#$%&''()*+,-./:;<=>@[\\]^_`{|}~"
    return (f"trim(regexp_replace(regexp_replace(translate(regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g'), '{punct}', ''), "
            f"'([!?])', ' \\1 ', 'g'), '\\s+', ' ', 'g'))")


def _model_text(title: str, body: str) -> str:
    return f"trim(regexp_replace(lower(CASE WHEN {title} = '' THEN {body} ELSE {title} || ' ' || {body} END), '\\s+', ' ', 'g'))"


# The wording of the prompts, as in functions/prompts.py.
RULES = ("E'Requirements:\\n- Mention only recurring themes supported by the reviews.\\n- Do not invent details.\\n"
         "- Prefer concrete themes over generic praise/complaints.\\n- Write one concise summary in 1-3 sentences.'")


def _prompt(title: str, category: str, sentiment: str, block: str) -> str:
    return (f"'Summarize the main ' || {sentiment} || E' customer feedback for this product.\\n\\nProduct title: ' || {title} || "
            f"E'\\nCategory: ' || {category} || E'\\n\\nReviews:\\n' || {block} || E'\\n\\n' || {RULES}")


def _block(text: str, rank: str = "rank") -> str:
    return f"string_agg({rank} || '. ' || {text}, E'\\n' ORDER BY {rank})"


# Insights -----------------------------------------------------------------------------------------------

ORACLES["insight_distribution"] = f"""WITH {DOC_REVIEWS}, {_routed()}
{DISTRIBUTION}, max(total_reviews) AS total_available_reviews FROM routed GROUP BY product_id"""

_SNIPPET = "CASE WHEN length({t}) > {n} THEN rtrim(substr({t}, 1, {n} - 3), E' \\t\\n\\r') || '...' ELSE {t} END"

ORACLES["insight_distribution_model"] = ORACLES["insight_distribution"].replace(
    "coalesce(given, rated, 'positive')", "coalesce(given, rated, CASE WHEN length(review_text) % 2 = 0 THEN 'negative' ELSE 'neutral' END)")

ORACLES["insight_representatives"] = f"""WITH {DOC_REVIEWS}, {_routed()}, {PICKED}
SELECT product_id, sentiment_label, rank, review_id, coalesce(review_title, '') AS review_title,
  {_SNIPPET.format(t=f'trim(review_text, {_STRIP})', n=220)} AS snippet,
  round(sentiment_confidence, 4) AS sentiment_confidence, helpful_vote, verified_purchase, round(q, 4) AS review_quality_score, "timestamp"
FROM picked WHERE rank <= 5"""

_DOC_PROMPTS = f"""WITH {DOC_REVIEWS}, {DOC_META}, {_routed()}, {PICKED},
prompts AS (SELECT p.product_id, p.sentiment_label, count(*) AS items, string_agg(p.review_id, ',' ORDER BY rank) AS review_ids,
  {_prompt('any_value(m.product_title)', 'any_value(m.main_category)', 'p.sentiment_label', _block(f'trim(p.review_text, {_STRIP})'))} AS prompt
  FROM picked p JOIN doc_meta m USING (product_id) WHERE rank <= KK GROUP BY p.product_id, p.sentiment_label)"""

ORACLES["insight_prompts"] = _DOC_PROMPTS.replace("KK", "3") + " SELECT product_id, sentiment_label, items, prompt FROM prompts"

ORACLES["insight_document_files"] = _DOC_PROMPTS.replace("KK", "2") + """,
sums AS (SELECT product_id, max(total_reviews) AS total FROM routed GROUP BY product_id)
SELECT product_id || '.json' AS file_name, product_id, total AS total_available_reviews, 'Source ' || product_id AS product_title FROM sums"""
ORACLES["insight_payload_fields"] = _DOC_PROMPTS.replace("KK", "2") + """,
sums AS (SELECT product_id, count(*) AS n, max(total_reviews) AS total FROM routed GROUP BY product_id),
per AS (SELECT product_id, sentiment_label, count(*) AS c FROM routed GROUP BY ALL)
SELECT s.product_id, 'Source ' || s.product_id AS product_title, s.n AS selected_review_count, s.total AS total_available_reviews,
  'summary-sft-candidate' AS model_version, l.sentiment_label, coalesce(per.c, 0) AS label_count,
  round(coalesce(per.c, 0) / s.n::DOUBLE, 4) AS label_ratio, coalesce(p.review_ids, '') AS review_ids, md5(coalesce(p.prompt, '')) AS prompt_md5,
  CASE WHEN p.items IS NULL THEN '' ELSE 'Placeholder ' || l.sentiment_label || ' summary generated from ' || p.items || ' representative reviews.' END AS summary
FROM sums s CROSS JOIN (VALUES ('positive'), ('neutral'), ('negative')) l(sentiment_label)
LEFT JOIN per ON per.product_id = s.product_id AND per.sentiment_label = l.sentiment_label
LEFT JOIN prompts p ON p.product_id = s.product_id AND p.sentiment_label = l.sentiment_label"""

_EXISTING = """existing AS (SELECT product_id, epoch_ms(max("timestamp") // 1000 * 1000) AS created_at, 'old ' || count(*) AS payload
  FROM doc_reviews GROUP BY product_id HAVING ascii(right(product_id, 1)) % 3 <> 0)"""

ORACLES["insights_incremental"] = f"""WITH {DOC_REVIEWS}, {_EXISTING},
due AS (SELECT * FROM doc_reviews WHERE product_id NOT IN (SELECT product_id FROM existing
  WHERE created_at >= (SELECT max(created_at) FROM existing) - INTERVAL 10 DAY)), {_routed(source='due')}
{DISTRIBUTION}, max(total_reviews) AS total_available_reviews FROM routed GROUP BY product_id"""

ORACLES["insights_upsert"] = f"""WITH {DOC_REVIEWS}, {_EXISTING}, {_routed()},
fresh AS (SELECT product_id, 'new ' || count(*) FILTER (sentiment_label = 'positive') AS payload FROM routed GROUP BY product_id
  HAVING count(*) FILTER (sentiment_label = 'positive') > 5)
SELECT coalesce(e.product_id, f.product_id) AS product_id, 'summary-sft-candidate' AS model_version, coalesce(f.payload, e.payload) AS payload,
  strftime(coalesce(e.created_at, TIMESTAMP '2030-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS created_at
FROM existing e FULL OUTER JOIN fresh f ON e.product_id = f.product_id"""

ORACLES["insert_if_absent"] = f"""WITH {DOC_REVIEWS}, batch AS (SELECT CASE WHEN position % 3 <> 0 THEN review_id
    ELSE md5(product_id || '|' || position || '|' || substr(review_text, 1, 100)) END AS review_id, product_id, position FROM doc_reviews)
SELECT review_id, product_id, position FROM batch WHERE review_id NOT IN (SELECT review_id FROM doc_reviews WHERE position % 4 = 0)
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY position) = 1"""

ORACLES["sentiment_routing"] = f"""WITH {DOC_REVIEWS}, {ROUTE.replace('{source}', 'doc_reviews')}
SELECT review_id, sentiment_label, round(sentiment_confidence, 6) AS sentiment_confidence, sentiment_source FROM routed"""

# Catalog ------------------------------------------------------------------------------------------------

_CATALOG = f"""{FACT_REVIEWS}, {PART_META},
totals AS (SELECT product_id, count(*) AS review_count, avg(rating) AS avg_review_rating, count(*) FILTER (verified_purchase) AS verified_review_count,
  CAST(sum(helpful_vote) AS BIGINT) AS total_helpful_votes, max("timestamp") AS latest_review_ts FROM fact_reviews GROUP BY product_id),
texts AS (SELECT product_id, nullif(trim(product_title), '') AS product_title, store, main_category, price, average_rating, coalesce(rating_number, 0) AS rating_number,
  CASE p_partkey % 5 WHEN 0 THEN p_type || '|' || p_brand WHEN 1 THEN p_type || '|x' WHEN 3 THEN p_name ELSE '' END AS categories_list,
  CASE WHEN p_partkey % 4 = 0 THEN 'size ' || p_size || ' | ' || p_brand END AS features_text,
  CASE WHEN p_partkey % 3 = 0 THEN p_name END AS description_text,
  CASE p_partkey % 6 WHEN 0 THEN 'https://img/' || p_partkey || '.jpg' WHEN 1 THEN 'https://img/' || p_partkey || '-a.jpg'
    WHEN 2 THEN 'https://img/' || p_partkey || '-t.jpg' END AS image_url FROM part_meta),
built AS (SELECT t.product_id, product_title, store, main_category, price, average_rating, rating_number, review_count, round(avg_review_rating, 6) AS avg_review_rating,
  verified_review_count, total_helpful_votes, latest_review_ts, image_url, categories_list, features_text, description_text,
  lower(trim(coalesce(product_title, '') || ' ' || store || ' ' || main_category || ' ' || replace(categories_list, '|', ' ') || ' ' ||
    coalesce(features_text, '') || ' ' || coalesce(description_text, ''))) AS search_text
FROM texts t JOIN totals USING (product_id))"""

ORACLES["catalog_build"] = f"WITH {_CATALOG} SELECT * FROM built"
ORACLES["catalog_cards"] = f"""WITH {_CATALOG} SELECT product_id, coalesce(product_title, '') AS product_title, store, main_category, price, average_rating,
  rating_number, review_count, image_url FROM built"""

_PARTS = f"""{PART_META}, parts AS (SELECT product_id, product_title, store, main_category,
  lower(trim(product_title || ' ' || store || ' ' || main_category)) AS search_text FROM part_meta)"""


def _match(q: str) -> str:
    return " OR ".join(f"{c} ILIKE '%{q}%'" for c in ("product_id", "product_title", "store", "main_category", "search_text"))


ORACLES["catalog_search"] = f"WITH {_PARTS} SELECT * FROM parts WHERE {_match('BRAND#1_')}"
ORACLES["catalog_search_count"] = f"WITH {_PARTS} SELECT count(*) AS total FROM parts WHERE {_match('ring')}"
ORACLES["catalog_page"] = f"WITH {_PARTS} SELECT * FROM parts WHERE {_match('ring')} ORDER BY product_id LIMIT 25 OFFSET 50"
ORACLES["catalog_lookup"] = f"""WITH {_PARTS} SELECT * FROM parts WHERE product_id IN (SELECT CAST(max(p_partkey) AS VARCHAR) FROM part
  UNION ALL SELECT CAST(min(p_partkey) AS VARCHAR) FROM part UNION ALL SELECT 'none')"""
ORACLES["catalog_search_indexed"] = f"WITH {_PARTS} " + " UNION ALL ".join(
    f"SELECT '{q}' AS query, product_id, product_title FROM parts WHERE {_match(q)}" for q in ("BRAND#1_", "ring", "no such words", "#2"))
ORACLES["catalog_page_seek"] = f"WITH {_PARTS} SELECT * FROM parts ORDER BY product_id LIMIT 25 OFFSET (SELECT count(*) - 60 FROM part)"
ORACLES["catalog_product"] = f"WITH {_PARTS} SELECT * FROM parts WHERE product_id = (SELECT CAST(max(p_partkey) AS VARCHAR) FROM part)"
ORACLES["leading_images"] = """SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE p_partkey % 6 WHEN 0 THEN 'https://img/' || p_partkey || '.jpg' END AS image_url FROM part"""
ORACLES["popular_products"] = """SELECT CAST(l_partkey AS VARCHAR) AS product_id, count(*) AS review_count FROM lineitem GROUP BY l_partkey HAVING count(*) >= 20
ORDER BY review_count DESC, product_id LIMIT 100"""

_INDEX = f"""{DOC_REVIEWS}, usable AS (SELECT *, trim(review_text, {_STRIP}) AS body, row_number() OVER (ORDER BY position) AS ordinal FROM doc_reviews
  WHERE product_id <> '' AND trim(review_text, {_STRIP}) <> ''),
firsts AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY product_id, body, "timestamp" ORDER BY ordinal) = 1)"""

ORACLES["reviews_index"] = f"""WITH {_INDEX} SELECT 'rvw_' || ordinal AS review_id, product_id, trim(review_title) AS review_title, md5(body) AS review_text,
  length(body) AS review_char_len, "timestamp", rating, strftime(epoch_ms("timestamp"), '%Y-%m-%d %H:%M:%S') AS review_datetime, helpful_vote, verified_purchase,
  coalesce(trim(images) <> '', false) AS has_review_image FROM firsts"""
ORACLES["reviews_index_by_file"] = ORACLES["reviews_index"]
ORACLES["serving_rows"] = f"""WITH {_INDEX} SELECT 'rvw_' || ordinal AS review_id, product_id, coalesce(trim(review_title), '') AS review_title, length(body) AS review_char_len,
  helpful_vote, verified_purchase, coalesce(trim(images) <> '', false) AS has_review_image, rating FROM firsts"""

# Ingest and cleaning --------------------------------------------------------------------------------------


def _pick(by: int, *values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE doc_id % {by} {cases} END"


_SOURCE = f"""source AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 13 <> 1 THEN source END AS product_id,
  TRY_CAST(nullif(replace(replace(trim({_pick(7, '5', '4.0', ' $3.5 ', '1,000', 'bad', None, '')}), ',', ''), '$', ''), '') AS DOUBLE) AS rating,
  lang AS review_title, CASE WHEN doc_id % 10 = 0 THEN '' ELSE trim(text, {_STRIP}) END AS body,
  CAST(trunc(TRY_CAST({_pick(6, '1588687728923', '1588687728923.0', 'x', None, '-4.7', '1e3')} AS DOUBLE)) AS BIGINT) AS "timestamp",
  CAST(trunc(TRY_CAST({_pick(5, '3', '2.9', '', None, '-1')} AS DOUBLE)) AS BIGINT) AS helpful_vote,
  CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 7 THEN true END AS verified_purchase FROM documents),
valid AS (SELECT * FROM source WHERE product_id <> '' AND body <> '' AND rating IS NOT NULL)"""

ORACLES["ingest_coerce"] = f"""WITH {_SOURCE} SELECT product_id, rating, review_title, md5(body) AS review_text, "timestamp", helpful_vote, verified_purchase, '[]' AS images FROM valid"""
ORACLES["ingest_counts"] = f"WITH {_SOURCE} SELECT (SELECT count(*) FROM source) AS scanned, count(*) AS valid, count(DISTINCT product_id) AS products FROM valid"
ORACLES["ingest_first_rows"] = f"WITH {_SOURCE} SELECT doc_id FROM valid ORDER BY doc_id LIMIT 50"
ORACLES["ingest_meta_semi"] = f"""WITH {PART_META} SELECT product_id, product_title, store FROM part_meta WHERE p_partkey IN (SELECT l_partkey FROM lineitem)"""
ORACLES["products_without_meta"] = """SELECT DISTINCT CAST(doc_id AS VARCHAR) AS product_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["loadable_reviews"] = f"""WITH {DOC_REVIEWS} SELECT CASE WHEN position % 2 = 0 THEN review_id ELSE md5(product_id || '|' || position || '|' || substr(review_text, 1, 100)) END AS review_id,
  product_id, position FROM doc_reviews WHERE product_id IN (SELECT source FROM documents GROUP BY source HAVING min(lang) = 'de') AND trim(review_text, {_STRIP}) <> ''"""
ORACLES["meta_typed"] = """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_title, CASE WHEN p_partkey % 3 = 0 THEN 4.5::DOUBLE END AS average_rating,
  CAST(p_size AS BIGINT) AS rating_number, CAST(1000 + p_partkey % 1000 AS DOUBLE) AS price, p_brand AS store, p_type AS main_category FROM part WHERE p_partkey % 10 <> 0"""

ORACLES["clean_text_docs"] = f"""WITH c AS (SELECT doc_id, {_clean('text')} AS clean_text, {_clean('lang')} AS clean_title FROM documents)
SELECT doc_id, clean_text, md5({_model_text('clean_title', 'clean_text')}) AS text_md5, {_tokens('clean_text')} AS tokens,
  {_SNIPPET.format(t='clean_text', n=60)} AS snippet FROM c"""

ORACLES["clean_text_pages"] = f"""WITH c AS (SELECT page_id, {_clean("replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')")} AS clean_text FROM pages)
SELECT page_id, clean_text, {_tokens('clean_text')} AS token_count FROM c"""

_CLEANED = f"""{DOC_REVIEWS}, {DOC_META},
cleaned AS (SELECT position, product_id, rating, {_clean('review_title')} AS review_title, {_clean('review_text')} AS review_text, "timestamp", helpful_vote,
  CAST(verified_purchase AS BIGINT) AS verified_purchase FROM doc_reviews WHERE product_id IS NOT NULL AND rating IS NOT NULL AND review_text IS NOT NULL),
texted AS (SELECT *, {_model_text('review_title', 'review_text')} AS text FROM cleaned WHERE review_text <> ''),
kept AS (SELECT *, {_tokens('text')} AS text_len FROM texted WHERE {_tokens('text')} >= 3
  QUALIFY row_number() OVER (PARTITION BY product_id, rating, review_text, "timestamp" ORDER BY position) = 1),
final AS (SELECT *, CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' ELSE 'negative' END AS sentiment_label FROM kept)"""

_REVIEW_HASH = """md5(product_id || '||' || coalesce(CAST(rating AS VARCHAR), '') || '||' || coalesce(CAST("timestamp" AS VARCHAR), '') || '||' || review_text)"""

ORACLES["phase1_clean"] = f"""WITH {_CLEANED}
SELECT {_REVIEW_HASH} AS review_id, product_id, rating, review_title, md5(review_text) AS review_text, md5(text) AS text, sentiment_label, "timestamp", helpful_vote,
  verified_purchase, text_len, m.product_title, m.rating_number, m.store, m.main_category FROM final LEFT JOIN doc_meta m USING (product_id)"""

ORACLES["review_ids"] = f"""WITH {DOC_REVIEWS} SELECT position, {_REVIEW_HASH} AS hash_id,
  md5(product_id || '|' || position || '|' || substr(review_text, 1, 100)) AS load_id, sha1(review_text) AS text_sha1, product_id || '||' || lang AS request_key,
  'product_insight:' || product_id || ':v1' AS insight_key, product_id || '_ü_x-_' AS file_name, lower(lang) || '_home_goods' AS slug FROM doc_reviews"""

ORACLES["dedupe_keep_first"] = """SELECT l_partkey, l_returnflag, l_linestatus, l_orderkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1"""

# Splits -----------------------------------------------------------------------------------------------------


def _quota(source: str, size: str, share: str, out: str) -> str:
    return f"""SELECT *, CAST(b + CASE WHEN row_number() OVER (ORDER BY e - b DESC, sentiment_label) <= t - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {out}
  FROM (SELECT *, floor(e) AS b FROM (SELECT *, {size} * t / sum({size}) OVER () AS e FROM (SELECT *, ceil(sum({size}) OVER () * {share}::DOUBLE) AS t FROM {source})))"""


_LABEL_RANKS = f"""{DOC_REVIEWS}, {GROUPS}, ranked AS (SELECT review_id, sentiment_label,
  row_number() OVER (PARTITION BY sentiment_label ORDER BY md5('42|' || review_id)) AS r FROM group_reviews)"""

ORACLES["split_stratified"] = f"""WITH {_LABEL_RANKS}, sizes AS (SELECT sentiment_label, count(*) AS n FROM group_reviews GROUP BY 1),
q1 AS ({_quota('sizes', 'n', '0.15', 'q_test')}),
q2 AS ({_quota('(SELECT sentiment_label, q_test, n - q_test AS rest FROM q1)', 'rest', '(0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))', 'q_val')})
SELECT review_id, sentiment_label, CASE WHEN r <= q_test THEN 'test' WHEN r <= q_test + q_val THEN 'val' ELSE 'train' END AS split
FROM ranked JOIN q2 USING (sentiment_label)"""

_PHASE1 = f"""{_CLEANED}, ids AS (SELECT {_REVIEW_HASH} AS review_id, sentiment_label FROM final),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5('42|' || review_id)) AS r FROM ids),
sizes AS (SELECT sentiment_label, count(*) AS n FROM ids GROUP BY 1),
q1 AS ({_quota('sizes', 'n', '0.15', 'q_test')}),
q2 AS ({_quota('(SELECT sentiment_label, q_test, n - q_test AS rest FROM q1)', 'rest', '(0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))', 'q_val')}),
parts AS (SELECT review_id, sentiment_label, CASE WHEN r <= q_test THEN 'test' WHEN r <= q_test + q_val THEN 'val' ELSE 'train' END AS split FROM ranked JOIN q2 USING (sentiment_label))"""
ORACLES["phase1_splits"] = f"WITH {_PHASE1} SELECT * FROM parts"
ORACLES["phase1_folds"] = f"""WITH {_PHASE1} SELECT review_id, sentiment_label, ntile(5) OVER (PARTITION BY sentiment_label ORDER BY md5('42|' || review_id)) AS fold
FROM parts WHERE split <> 'test'"""

ORACLES["phase1_files"] = f"""WITH {_PHASE1}, folds AS (SELECT sentiment_label, ntile(5) OVER (PARTITION BY sentiment_label ORDER BY md5('42|' || review_id)) AS fold FROM parts WHERE split <> 'test')
SELECT 'split ' || split AS part, sentiment_label, count(*) AS n FROM parts GROUP BY ALL UNION ALL SELECT 'fold ' || fold, sentiment_label, count(*) FROM folds GROUP BY ALL"""
ORACLES["split_kfold"] = f"""WITH {DOC_REVIEWS}, {GROUPS} SELECT review_id, sentiment_label,
  ntile(5) OVER (PARTITION BY sentiment_label ORDER BY md5('42|' || review_id)) AS fold FROM group_reviews"""

_GROUP_SPLIT = """ids AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS product_id FROM lineitem),
ranked AS (SELECT product_id, row_number() OVER (ORDER BY md5('42|' || product_id)) AS r, count(*) OVER () AS n FROM ids),
parts AS (SELECT product_id, CASE WHEN r <= ceil(ceil(n * 0.2) * 0.5) THEN 'test' WHEN r <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM ranked)"""
ORACLES["split_group"] = f"WITH {_GROUP_SPLIT} SELECT product_id, split FROM parts"
ORACLES["split_summary"] = f"""WITH {_GROUP_SPLIT} SELECT split, count(*) AS row_count, count(DISTINCT product_id) AS product_count
FROM lineitem JOIN parts ON product_id = CAST(l_partkey AS VARCHAR) GROUP BY split"""

# Quality, groups, selection ------------------------------------------------------------------------------------

_GLOBAL = f"""{FACT_REVIEWS}, ends AS (SELECT min(ln(1 + helpful_vote::DOUBLE)) AS lo, max(ln(1 + helpful_vote::DOUBLE)) AS hi FROM fact_reviews),
normed AS (SELECT f.*, {_norm('lo', 'hi')} AS nv, {_length_score('text_len')} AS ls FROM fact_reviews f, ends),
scored AS (SELECT *, {_quality('nv', 'verified_purchase', 'ls')} AS q FROM normed)"""
ORACLES["quality_score_global"] = f"""WITH {_GLOBAL} SELECT product_id, l_orderkey, helpful_vote, verified_purchase, text_len, round(nv, 6) AS helpful_vote_norm,
  round(ls, 6) AS length_score, round(q, 6) AS review_quality_score FROM scored"""
ORACLES["quality_score_per_product"] = f"""WITH {FACT_REVIEWS}, ranged AS (SELECT *, min(ln(1 + helpful_vote::DOUBLE)) OVER p AS lo, max(ln(1 + helpful_vote::DOUBLE)) OVER p AS hi,
    count(*) OVER p AS total_reviews FROM fact_reviews WINDOW p AS (PARTITION BY product_id)),
normed AS (SELECT *, {_norm('lo', 'hi')} AS nv, {_length_score('text_len')} AS ls FROM ranged)
SELECT product_id, l_orderkey, helpful_vote, total_reviews, round(nv, 6) AS helpful_vote_norm, round(ls, 6) AS length_score,
  round({_quality('nv', 'verified_purchase', 'ls')}, 6) AS review_quality_score FROM normed"""
ORACLES["group_stats"] = f"""WITH {FACT_REVIEWS} SELECT product_id, sentiment_label, count(*) AS group_size, sum(rating) AS rating_sum FROM fact_reviews
GROUP BY 1, 2 HAVING count(*) >= 3"""
ORACLES["group_topk"] = f"""WITH {_GLOBAL}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id, sentiment_label ORDER BY q DESC, helpful_vote DESC, verified_purchase DESC,
  text_len DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS position FROM scored)
SELECT product_id, sentiment_label, position, l_orderkey, l_suppkey, round(q, 6) AS review_quality_score FROM r WHERE position <= 6"""

_PRODUCT_GROUPS = f"""{DOC_REVIEWS}, {GROUPS},
kept AS (SELECT * FROM group_reviews WHERE trim(text, {_STRIP}) <> ''),
ends AS (SELECT min(ln(1 + helpful_vote::DOUBLE)) AS lo, max(ln(1 + helpful_vote::DOUBLE)) AS hi FROM kept),
scored AS (SELECT k.*, {_quality(_norm('lo', 'hi'), 'verified_purchase', _length_score('text_len'))} AS q FROM kept k, ends),
sized AS (SELECT *, count(*) OVER (PARTITION BY product_id, sentiment_label) AS gs, row_number() OVER (PARTITION BY product_id, sentiment_label
  ORDER BY q DESC, helpful_vote DESC, verified_purchase DESC, text_len DESC, "timestamp" NULLS FIRST, review_id) AS rank FROM scored),
members AS (SELECT * FROM sized WHERE gs >= 3)"""

_SIDES = ("positive", "neutral", "negative")
ORACLES["product_groups"] = f"""WITH {_PRODUCT_GROUPS} SELECT product_id, any_value(product_title) AS product_title, any_value(main_category) AS main_category,
  count(*) AS review_count, round(sum(rating) / count(*), 4) AS avg_rating_from_reviews,
  {', '.join(f"count(*) FILTER (sentiment_label = '{s}') AS {s}_count, count(*) FILTER (sentiment_label = '{s}' AND rank <= 6) AS {s}_selected_count, round(count(*) FILTER (sentiment_label = '{s}') / count(*)::DOUBLE, 4) AS {s}_ratio" for s in _SIDES)},
  {', '.join(f"string_agg(review_id, ',' ORDER BY rank) FILTER (sentiment_label = '{s}' AND rank <= 6) AS {s}_x" for s in _SIDES)}
FROM members GROUP BY product_id"""
for _s in _SIDES:
    ORACLES["product_groups"] = ORACLES["product_groups"].replace(
        f"string_agg(review_id, ',' ORDER BY rank) FILTER (sentiment_label = '{_s}' AND rank <= 6) AS {_s}_x",
        f"coalesce(string_agg(review_id, ',' ORDER BY rank) FILTER (sentiment_label = '{_s}' AND rank <= 6), '') AS {_s}_ids")


def _diverse(limit: int, threshold: float) -> str:
    """Greedy selection as a recursive query: each step finds the next row to keep."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
g AS (SELECT label, 1 AS c, [e] AS es, [vec_id] AS ids, vec_id AS last FROM v WHERE r = 1
  UNION ALL
  SELECT label, c + 1, list_append(any_value(es), arg_min(e, vec_id)), list_append(any_value(ids), min(vec_id)), min(vec_id)
  FROM (SELECT g.*, v.e, v.vec_id FROM g JOIN v USING (label) WHERE g.c < {limit} AND v.vec_id > g.last
    AND len(list_filter(g.es, lambda k: list_dot_product(k, v.e) >= {threshold})) = 0) GROUP BY label, c),
fin AS (SELECT label, arg_max(ids, c) AS ids, arg_max(es, c) AS es FROM g GROUP BY label),
flagged AS (SELECT v.label, v.vec_id, v.n <= {limit} OR list_contains(fin.ids, v.vec_id) AS kept FROM v JOIN fin USING (label)),
chosen AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY label ORDER BY kept DESC, vec_id) <= {limit})"""


ORACLES["diverse_selection"] = _diverse(6, 0.3) + " SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position, vec_id, kept FROM chosen"
ORACLES["diverse_selection_strict"] = _diverse(10, 0.08) + " SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position, vec_id, kept FROM chosen"
ORACLES["similarity_to_kept"] = _diverse(6, 0.3) + """ SELECT v.label, v.vec_id, round(list_max(list_transform(fin.es, lambda k: list_dot_product(k, v.e))), 5) AS max_similarity
FROM v JOIN fin USING (label)"""

# Summary dataset ------------------------------------------------------------------------------------------------

_TASKS = f"""{_PRODUCT_GROUPS},
texts AS (SELECT product_id, sentiment_label AS sentiment, product_title, main_category, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t,
  count(*) OVER (PARTITION BY product_id, sentiment_label) AS original FROM members WHERE rank <= 6),
uniq AS (SELECT * FROM texts WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY product_id, sentiment, lower(t) ORDER BY rank) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY product_id, sentiment ORDER BY rank) AS i FROM uniq QUALIFY i <= 5),
present AS (SELECT product_id, count(DISTINCT sentiment) AS present FROM texts GROUP BY product_id),
tasks AS (SELECT product_id, sentiment, count(*) AS source_review_count, any_value(original) AS original_sentiment_count,
  {_prompt("any_value(product_title)", "coalesce(any_value(main_category), 'Unknown category')", 'sentiment', _block('t', 'i'))} AS prompt, any_value(present) AS present
  FROM numbered JOIN present USING (product_id) GROUP BY product_id, sentiment)"""

ORACLES["summary_tasks"] = f"""WITH {_TASKS} SELECT product_id, sentiment, source_review_count, original_sentiment_count, sha1(prompt) AS prompt_hash,
  product_id || '||' || sentiment AS request_key FROM tasks WHERE present >= 2"""
ORACLES["summary_tasks_remaining"] = f"""WITH {_TASKS} SELECT product_id, sentiment FROM tasks WHERE (product_id, sentiment) NOT IN
  (SELECT (product_id, sentiment_label) FROM group_reviews WHERE rating = 1)"""
ORACLES["summary_records"] = f"""WITH {_TASKS}, a AS (SELECT product_id, sentiment, sha1(prompt) AS prompt_hash, prompt,
  position('Category: Unknown' IN prompt) = 0 OR length(prompt) % 3 = 0 AS failed FROM tasks)
SELECT product_id, sentiment, prompt_hash, CASE WHEN NOT failed THEN length(prompt) || ' characters' END AS gold_summary, CASE WHEN failed THEN 'declined' END AS error FROM a"""
ORACLES["stage_counts"] = f"""WITH {_TASKS}, metas AS (SELECT source, min(lang) AS lang FROM documents GROUP BY source)
SELECT 'generation' AS stage, 'written' AS name, count(*) AS n FROM tasks WHERE sentiment <> 'neutral' AND length(product_id) % 2 = 0
UNION ALL SELECT 'generation', 'failed', count(*) FROM tasks WHERE sentiment <> 'neutral' AND length(product_id) % 2 = 1
UNION ALL SELECT 'generation', 'skipped', count(*) FROM tasks WHERE sentiment = 'neutral'
UNION ALL SELECT 'language', 'before', count(*) FROM documents UNION ALL SELECT 'language', 'kept', count(*) FROM documents WHERE lang = 'en'
UNION ALL SELECT 'metadata', 'matched', count(*) FROM metas WHERE lang <> 'en' UNION ALL SELECT 'metadata', 'missing', count(*) FROM metas WHERE lang = 'en'"""
ORACLES["chat_splits"] = f"""WITH {_TASKS}, ids AS (SELECT DISTINCT product_id FROM tasks),
ranked2 AS (SELECT product_id, row_number() OVER (ORDER BY md5('42|' || product_id)) AS r, count(*) OVER () AS n FROM ids),
parts AS (SELECT product_id, CASE WHEN r <= ceil(ceil(n * 0.2) * 0.5) THEN 'test' WHEN r <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM ranked2)
SELECT product_id, sentiment, split, md5(prompt) AS user_md5, 'About ' || sentiment || ' reviews.' AS assistant FROM tasks JOIN parts USING (product_id)"""

ORACLES["chat_files"] = f"SELECT split, user_md5, assistant, true AS valid FROM ({ORACLES['chat_splits']})"
_CONV = f"""conv AS (SELECT conv_id, count(*) AS messages, bool_and(role IS NOT NULL AND coalesce(trim(text, {_STRIP}), '') <> '') AND count(*) >= 2 AS valid,
  trim(arg_max(text, turn) FILTER (role = 'user'), {_STRIP}) AS prompt, trim(arg_max(text, turn) FILTER (role = 'assistant'), {_STRIP}) AS reference_answer
  FROM conversations GROUP BY conv_id)"""
ORACLES["messages_validate"] = f"WITH {_CONV} SELECT conv_id, messages, valid FROM conv"
ORACLES["messages_as_lists"] = f"WITH {_CONV} SELECT conv_id, messages, valid, prompt, reference_answer FROM conv"
ORACLES["summary_predictions"] = f"""WITH {_CONV} SELECT conv_id, prompt, reference_answer,
  array_to_string(list_slice(regexp_split_to_array(trim(prompt, {_STRIP}), '\\s+'), 1, 20), ' ') AS generated_answer, true AS timed FROM conv WHERE prompt IS NOT NULL"""
ORACLES["messages_extract"] = f"""WITH {_CONV} SELECT conv_id, prompt, reference_answer, CASE WHEN prompt IS NULL THEN 'no user turn'
  WHEN reference_answer IS NULL THEN 'no assistant turn' END AS problem FROM conv"""

# Statistics --------------------------------------------------------------------------------------------------------

_REQUESTS = """requests AS (SELECT event_type, ts, value AS latency_ms, CAST(200 + (k % 4) * 100 AS BIGINT) AS status,
  CASE WHEN k % 10 < 7 THEN 'finished' WHEN k % 10 < 9 THEN 'failed' ELSE 'queued' END AS job_status, value / 100 AS seconds
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
_ORDERED = _REQUESTS + """, sorted AS (SELECT event_type, list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n, round(avg(latency_ms), 2) AS mean,
  round(min(latency_ms), 2) AS lo, round(max(latency_ms), 2) AS hi, count(*) FILTER (status BETWEEN 200 AND 299) AS ok FROM requests GROUP BY event_type)"""
ORACLES["latency_linear"] = f"""WITH {_REQUESTS} SELECT event_type, count(*) AS count, round(avg(latency_ms), 2) AS mean_ms, round(min(latency_ms), 2) AS min_ms,
  round(max(latency_ms), 2) AS max_ms, {', '.join(f'round(quantile_cont(latency_ms, {p / 100}), 2) AS p{p}_ms' for p in (50, 55, 90, 95, 99))}
FROM requests GROUP BY event_type"""
ORACLES["latency_nearest"] = f"""WITH {_ORDERED} SELECT event_type, n AS requests, ok AS success_count, round(ok / n::DOUBLE, 4) AS success_rate, mean AS avg_ms,
  {', '.join(f'round(v[CAST(round_even((n - 1) * {p}::DOUBLE, 0) AS BIGINT) + 1], 2) AS p{int(p * 100)}_ms' for p in (0.5, 0.95, 0.99))}, lo AS min_ms, hi AS max_ms FROM sorted"""
ORACLES["latency_floor"] = f"""WITH {_ORDERED} SELECT event_type, n AS count, lo AS min_ms, hi AS max_ms, mean AS mean_ms,
  round((v[CAST(floor((n - 1) / 2) AS BIGINT) + 1] + v[CAST(ceil((n - 1) / 2) AS BIGINT) + 1]) / 2, 2) AS p50_ms,
  round(v[CAST(floor((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1], 2) AS p95_ms FROM sorted"""
ORACLES["status_accounting"] = f"WITH {_REQUESTS} SELECT event_type, status, count(*) AS request_count FROM requests GROUP BY 1, 2"
ORACLES["job_outcomes"] = f"""WITH {_REQUESTS} SELECT event_type, count(*) AS job_count, count(*) FILTER (job_status = 'finished') AS finished_count,
  count(*) FILTER (job_status = 'failed') AS failed_count, count(*) FILTER (job_status = 'queued') AS other_count,
  round(count(*) FILTER (job_status = 'finished') / count(*)::DOUBLE, 4) AS success_rate, count(seconds) AS duration_count,
  round(avg(seconds), 2) AS duration_mean, round(max(seconds), 2) AS duration_max FROM requests GROUP BY event_type"""


def _buckets(bounds) -> str:
    return ", ".join(f"('{b!r}', {b!r}::DOUBLE)" for b in bounds) + ", ('+Inf', 'inf'::DOUBLE)"


ORACLES["histogram_buckets"] = f"""WITH {_REQUESTS} SELECT event_type, status, round(sum(seconds), 4) AS value_sum, count(*) AS value_count, le,
  count(*) FILTER (seconds <= b) AS bucket_count FROM requests CROSS JOIN (VALUES {_buckets((0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0))}) t(le, b)
GROUP BY event_type, status, le, b"""
ORACLES["label_distribution"] = f"WITH {DOC_REVIEWS}, {GROUPS} SELECT sentiment_label, count(*) AS row_count FROM group_reviews GROUP BY 1"
ORACLES["distinct_counts"] = """SELECT count(DISTINCT source) AS products, count(DISTINCT text) AS texts, count(DISTINCT (source, lang)) AS product_langs FROM documents"""
ORACLES["run_accounting"] = f"""WITH {_CLEANED} SELECT count(*) AS clean_rows, count(DISTINCT product_id) AS products,
  {', '.join(f"count(*) FILTER (sentiment_label = '{s}') AS {s}_rows" for s in _SIDES)}, (SELECT count(*) FROM documents) AS original_rows FROM final"""

# Evaluation -----------------------------------------------------------------------------------------------------------

_JUDGED = """judged AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS actual,
  CASE WHEN n_chars % 5 = 0 THEN 'negative' WHEN n_chars > 900 THEN 'positive' ELSE 'neutral' END AS predicted FROM labels JOIN documents d USING (doc_id))"""
_REPORT = _JUDGED + """, seen AS (SELECT DISTINCT label FROM (SELECT actual AS label FROM judged UNION ALL SELECT predicted FROM judged)),
counts AS (SELECT label, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS chosen,
  count(*) FILTER (actual = label AND predicted = label) AS hits FROM judged, seen GROUP BY label),
pr AS (SELECT *, CASE WHEN chosen > 0 THEN hits / chosen::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS r FROM counts),
report AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr),
metrics AS (SELECT sum(hits) / sum(support)::DOUBLE AS accuracy, avg(p) AS pm, avg(r) AS rm, avg(f) AS fm, sum(p * support) / sum(support) AS pw,
  sum(r * support) / sum(support) AS rw, sum(f * support) / sum(support) AS fw FROM report)"""
ORACLES["confusion_matrix"] = f"""WITH {_JUDGED} SELECT a.actual, {', '.join(f"count(*) FILTER (predicted = '{x}') AS pred_{x}" for x in _SIDES)}
FROM (VALUES ('positive'), ('neutral'), ('negative')) a(actual) LEFT JOIN judged USING (actual) GROUP BY a.actual"""
ORACLES["classification_report"] = f"WITH {_REPORT} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM report"
ORACLES["classification_metrics"] = f"""WITH {_REPORT} SELECT round(accuracy, 6) AS accuracy, round(pm, 6) AS precision_macro, round(rm, 6) AS recall_macro, round(fm, 6) AS f1_macro,
  round(pw, 6) AS precision_weighted, round(rw, 6) AS recall_weighted, round(fw, 6) AS f1_weighted FROM metrics"""
ORACLES["metrics_long"] = f"""WITH {_REPORT} SELECT name, round(value, 6) AS value FROM metrics, LATERAL (VALUES ('accuracy', accuracy), ('macro_precision', pm), ('macro_recall', rm),
  ('macro_f1', fm), ('weighted_avg_precision', pw), ('weighted_avg_recall', rw), ('weighted_avg_f1', fw)) t(name, value)"""
ORACLES["class_weights"] = f"""WITH {_JUDGED}, c AS (SELECT actual AS label, count(*) AS label_count FROM judged GROUP BY 1)
SELECT label, label_count, round(sum(label_count) OVER () / (count(*) OVER () * label_count::DOUBLE), 6) AS weight FROM c"""

_JUDGE = """j AS (SELECT doc_id, text, lang, n_chars % 5 + 1.0::DOUBLE AS faithfulness, (n_chars % 6)::DOUBLE AS coverage, n_chars % 4 + 2.0::DOUBLE AS sentiment_alignment,
  4.0::DOUBLE AS clarity, n_chars % 3 + 1.5::DOUBLE AS overall, n_chars % 9 <> 0 AND n_chars % 11 <> 0 AND n_chars % 6 > 0 AS valid FROM documents)"""
_FIVE = ("faithfulness", "coverage", "sentiment_alignment", "clarity", "overall")
ORACLES["judge_averages"] = f"WITH {_JUDGE} SELECT count(*) AS examples, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in _FIVE)} FROM j WHERE valid"


def _judge_prompt() -> str:
    from shelfsense.functions.prompts import JUDGE_HEAD, JUDGE_RULES

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    return f"trim({quoted(JUDGE_HEAD)} || text || {quoted(chr(10) * 2 + 'Generated summary:' + chr(10))} || lang || {quoted(chr(10) * 2 + JUDGE_RULES)}, {_STRIP})"


ORACLES["judge_scores"] = f"""WITH {_JUDGE} SELECT doc_id, md5({_judge_prompt()}) AS prompt_md5, valid, {', '.join(f'CASE WHEN valid THEN {c} END AS {c}' for c in _FIVE)} FROM j"""

_WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
ORACLES["soft_align_f1"] = f"""WITH {_CONV}, sides AS (SELECT conv_id, 'ref' AS side, reference_answer AS t FROM conv WHERE prompt IS NOT NULL AND reference_answer IS NOT NULL
  UNION ALL SELECT conv_id, 'cand', prompt FROM conv WHERE prompt IS NOT NULL AND reference_answer IS NOT NULL),
tokens AS (SELECT conv_id, side, unnest({_WORDS.format(t='t')}) AS token FROM sides),
located AS (SELECT conv_id, side, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id, count(*) AS n FROM tokens GROUP BY ALL),
vecs AS (SELECT conv_id, side, l.vec_id, n, CAST(embedding AS DOUBLE[]) AS e FROM located l JOIN embeddings USING (vec_id)),
sims AS (SELECT c.conv_id, c.vec_id AS cv, c.n AS cn, r.vec_id AS rv, r.n AS rn, list_cosine_similarity(c.e, r.e) AS s FROM vecs c JOIN vecs r ON c.conv_id = r.conv_id
  WHERE c.side = 'cand' AND r.side = 'ref'),
p AS (SELECT conv_id, sum(m * cn) / sum(cn) AS p FROM (SELECT conv_id, cv, cn, max(s) AS m FROM sims GROUP BY ALL) GROUP BY conv_id),
r AS (SELECT conv_id, sum(m * rn) / sum(rn) AS r FROM (SELECT conv_id, rv, rn, max(s) AS m FROM sims GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, round(p, 5) AS precision, round(r, 5) AS recall, round(2 * p * r / (p + r), 5) AS f1 FROM p JOIN r USING (conv_id)"""

# Text features -------------------------------------------------------------------------------------------------------------

ORACLES["distinct_counts_merged"] = f"SELECT *, true AS products_near, true AS texts_near, true AS product_langs_near FROM ({ORACLES['distinct_counts']})"
ORACLES["run_accounting_observed"] = f"""WITH {_CLEANED} SELECT 'raw' AS stage, 'rows' AS name, count(*) AS n FROM documents UNION ALL SELECT 'clean', 'rows', count(*) FROM final
""" + " ".join(f"UNION ALL SELECT 'clean', '{s}', count(*) FROM final WHERE sentiment_label = '{s}'" for s in _SIDES)

_TERMS = f"""words AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
occurrences AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM words WHERE len(w) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY term)"""
ORACLES["tfidf_df"] = f"WITH {_TERMS} SELECT * FROM df WHERE df >= 2 ORDER BY total_tf DESC, term LIMIT 30000"
ORACLES["tfidf_weights"] = f"""WITH {_TERMS}, vocabulary AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM df WHERE df >= 2
  ORDER BY total_tf DESC, term LIMIT 30000),
raw AS (SELECT doc_id, term, tf, tf * idf AS x FROM tf JOIN vocabulary USING (term))
SELECT doc_id, term, tf, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""

# Streams: each equals its batch form ---------------------------------------------------------------------------------------

ORACLES["stream_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"
_EVENT_REVIEWS = """doc_reviews AS (SELECT 'u' || user_id AS product_id, 'e' || event_id AS review_id, event_type AS review_text, CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS DOUBLE) AS rating,
  CAST(floor(value) AS BIGINT) AS helpful_vote, event_id % 2 = 0 AS verified_purchase, length(event_type) AS review_char_len, event_id AS "timestamp",
  CAST(NULL AS VARCHAR) AS predicted_sentiment, CAST(NULL AS DOUBLE) AS given_confidence FROM events)"""
ORACLES["stream_sentiment"] = f"""WITH {_EVENT_REVIEWS}, {ROUTE.replace('{source}', 'doc_reviews')} {DISTRIBUTION} FROM routed GROUP BY product_id"""
ORACLES["stream_insights"] = f"""WITH {_EVENT_REVIEWS}, {_routed()} SELECT product_id, {" || '/' || ".join(f"count(*) FILTER (sentiment_label = '{s}')" for s in _SIDES)} AS payload
FROM routed GROUP BY product_id"""
ORACLES["stream_histogram"] = f"""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, le, count(*) FILTER (value / 100 <= b) AS bucket_count
FROM events CROSS JOIN (VALUES {_buckets((0.1, 0.5, 1.0, 2.5))}) t(le, b) GROUP BY event_type, day, le, b"""
ORACLES["stream_totals"] = ORACLES["stream_sentiment"]
ORACLES["stream_first_by_time"] = """SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, CAST(event_id AS VARCHAR)) = 1"""
ORACLES["stream_insights_by_bucket"] = ORACLES["stream_insights"]
