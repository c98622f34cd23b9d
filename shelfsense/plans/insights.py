"""Insights for every product at once: best reviews, sentiment, representatives, prompts, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.functions.ids import file_safe
from shelfsense.functions.prompts import insight_prompt, placeholder_summary
from shelfsense.functions.text import null_to_blank, snippet
from shelfsense.operators.quality import product_quality
from shelfsense.operators.select import top_n
from shelfsense.operators.sentiment import Predictor, distribution_columns, route_sentiment
from shelfsense.operators.skew import HOT_ROWS
from shelfsense.plans.catalog import product_info
from shelfsense.schemas import CATALOG_COLUMNS, SENTIMENT_SOURCES, SENTIMENTS, column_or

MAX_REVIEWS = 100
REPRESENTATIVES = 5
MODEL_VERSION = "summary-sft-candidate"

# (prompt, sentiment, review count) -> summary column
Generator = Callable[[Column, Column, Column], Column]


def select_reviews(reviews: DataFrame, max_reviews: int = MAX_REVIEWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each product's best ``max_reviews`` reviews; scores see all of the product's reviews."""
    scored = product_quality(reviews, text="review_text", hot_rows=hot_rows)
    order = [
        F.desc(c) for c in ("review_quality_score", "helpful_vote", "verified_purchase", "review_char_len")
    ] + [F.desc_nulls_last("timestamp"), F.asc("review_id")]
    return top_n(scored, ["product_id"], order, max_reviews, "_selected").drop("_selected")


def routed_reviews(reviews: DataFrame, predictor: Predictor | None = None, max_reviews: int = MAX_REVIEWS,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """The selected reviews with their sentiment; the model sees selected, undecided reviews only."""
    return route_sentiment(select_reviews(reviews, max_reviews, hot_rows), predictor)


def distribution(routed: DataFrame) -> DataFrame:
    """Per product: label counts and ratios, label sources, selected and available reviews."""
    return routed.groupBy("product_id").agg(
        *distribution_columns(), F.max("total_reviews").alias("total_available_reviews")
    )


def _pick_order() -> list[Column]:
    return [
        F.desc("review_quality_score"), F.desc("sentiment_confidence"), F.desc("helpful_vote"),
        F.desc_nulls_last("timestamp"), F.asc("review_id"),
    ]


def _report(routed: DataFrame) -> dict[str, Column]:
    """The fields of a representative review in report form."""
    title = column_or(routed, "review_title", F.lit(None).cast("string"))
    return {
        "review_id": null_to_blank(F.col("review_id")),
        "review_title": null_to_blank(title),
        "review_text": null_to_blank(F.col("review_text")),
        "snippet": snippet(F.col("review_text")),
        "sentiment_label": F.col("sentiment_label"),
        "sentiment_confidence": F.round("sentiment_confidence", 4),
        "helpful_vote": F.coalesce(F.col("helpful_vote").cast("bigint"), F.lit(0)),
        "verified_purchase": F.coalesce(F.col("verified_purchase").cast("boolean"), F.lit(False)),
        "review_quality_score": F.round("review_quality_score", 4),
        "timestamp": F.col("timestamp").cast("bigint"),
        "review_datetime": column_or(routed, "review_datetime", F.lit(None)).cast("string"),
    }


def representatives(routed: DataFrame, k: int = REPRESENTATIVES) -> DataFrame:
    """The ``k`` best reviews per product and sentiment, in report form with ``rank`` 1..k."""
    best = top_n(routed, ["product_id", "sentiment_label"], _pick_order(), k)
    return best.select("product_id", "rank", *[c.alias(n) for n, c in _report(routed).items()])


def representative_groups(picked: DataFrame) -> DataFrame:
    """One row per product and sentiment with its at most k items in rank order."""
    return picked.groupBy("product_id", "sentiment_label").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.struct(*_report(picked)).alias("item")))), lambda x: x["item"]
        ).alias("items")
    )


def prompts(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Product, sentiment, items, prompt; products missing from the catalog are left out."""
    info = catalog.select("product_id", "product_title", "main_category")
    texts = F.transform("items", lambda i: i["review_text"])
    return groups.join(info, "product_id").select(
        "product_id", "sentiment_label", "items",
        insight_prompt(F.col("product_title"), F.col("main_category"), F.col("sentiment_label"), texts).alias("prompt"),
    )


def payloads(reviews: DataFrame, catalog: DataFrame, predictor: Predictor | None = None,
             generator: Generator = placeholder_summary, max_reviews: int = MAX_REVIEWS, k: int = REPRESENTATIVES,
             model_version: str = MODEL_VERSION, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One nested insight per product that is in the catalog and has reviews.

    Reviews move once more after ranking, at most ``max_reviews`` rows per product and task; picking,
    counting and assembling all happen in that one partitioning by product.
    """
    routed = routed_reviews(reviews, predictor, max_reviews, hot_rows)
    pick = W.partitionBy("product_id", "sentiment_label").orderBy(*_pick_order())
    ranked = routed.withColumn("_rank", F.row_number().over(pick))
    item = F.struct(*[c.alias(n) for n, c in _report(routed).items()])
    lists = []
    for s in SENTIMENTS:
        chosen = F.when((F.col("sentiment_label") == s) & (F.col("_rank") <= k), F.struct("_rank", item.alias("item")))
        lists.append(F.transform(F.sort_array(F.collect_list(chosen)), lambda x: x["item"]).alias(f"{s}_items"))
    per_product = ranked.groupBy("product_id").agg(
        *distribution_columns(), F.max("total_reviews").alias("total_available_reviews"), *lists
    )
    info = product_info(catalog).select("product_id", F.struct(*CATALOG_COLUMNS).alias("product_info"))
    joined = per_product.join(info, "product_id")
    for s in SENTIMENTS:
        has = F.size(f"{s}_items") > 0
        texts = F.transform(f"{s}_items", lambda i: i["review_text"])
        prompt = insight_prompt(F.col("product_info.product_title"), F.col("product_info.main_category"), F.lit(s), texts)
        joined = joined.withColumn(f"{s}_prompt", F.when(has, prompt).otherwise(F.lit("")))
        summary = null_to_blank(generator(F.col(f"{s}_prompt"), F.lit(s), F.size(f"{s}_items")))
        joined = joined.withColumn(f"{s}_summary", F.when(has, summary).otherwise(F.lit("")))

    def named(suffix: str, names=SENTIMENTS) -> Column:
        return F.struct(*[F.col(f"{s}_{suffix}").alias(s) for s in names])

    return joined.select(
        "product_id",
        "product_info",
        F.struct(named("count").alias("counts"), named("ratio").alias("ratios"), F.col("total")).alias("sentiment_distribution"),
        named("source", SENTIMENT_SOURCES).alias("sentiment_source_counts"),
        named("items").alias("representative_reviews"),
        named("prompt").alias("prompts"),
        named("summary").alias("summaries"),
        F.col("total").alias("selected_review_count"),
        "total_available_reviews",
        F.lit(model_version).alias("model_version"),
    )


def insight_rows(payload: DataFrame, created_at: Column) -> DataFrame:
    """Payloads as rows of the insight table."""
    fields = [c for c in payload.columns if c not in ("product_id", "model_version")]
    return payload.select(
        "product_id", "model_version", F.struct("product_id", *fields, "model_version").alias("payload"), created_at.alias("created_at")
    )


def insight_documents(payload: DataFrame) -> DataFrame:
    """File-safe name and JSON text per product."""
    return payload.select(
        F.concat(file_safe(F.col("product_id")), F.lit(".json")).alias("file_name"),
        F.to_json(F.struct(*payload.columns), {"ignoreNullFields": "false"}).alias("document"),
    )


def pending_products(products: DataFrame, insights: DataFrame, model_version: str = MODEL_VERSION, regenerate: bool = False,
                     now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Products to compute: all when regenerating, else those without an insight of this version, or, with
    a time to live, without a fresh one."""
    ids = products.select("product_id").distinct()
    if regenerate:
        return ids
    done = insights.where(F.col("model_version") == model_version)
    if ttl_seconds is not None:
        since = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))
        done = done.where(F.col("created_at") >= since)
    return ids.join(done.select("product_id"), "product_id", "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys=("product_id", "model_version")) -> DataFrame:
    """New payloads replace old ones, the old creation time survives, other rows stay."""
    old = existing.select(*keys, F.col("payload").alias("_old"), F.col("created_at").alias("_old_created"), F.lit(True).alias("_had"))
    fresh = new.select(*keys, F.col("payload").alias("_new"), F.col("created_at").alias("_new_created"), F.lit(True).alias("_has"))
    return old.join(fresh, list(keys), "full_outer").select(
        *keys,
        F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias("payload"),
        F.when(F.col("_had"), F.col("_old_created")).otherwise(F.col("_new_created")).alias("created_at"),
    )
