"""Raw reviews to clean, labelled, deduplicated training reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.coerce import flag_column, int_column, number_column
from shelfsense.functions.ids import review_hash
from shelfsense.functions.scoring import training_label
from shelfsense.functions.text import clean_review_text, model_text, token_count
from shelfsense.operators.bind import with_values
from shelfsense.operators.dedupe import all_columns, keep_first
from shelfsense.operators.splits import stratified_folds, stratified_split
from shelfsense.schemas import META_COLUMNS, REVIEW_REQUIRED, require_columns
from shelfsense.session import ensure_checkpoint_dir


def clean_fields(raw: DataFrame, min_tokens: int = 3, entities: bool = True) -> DataFrame:
    """Cleaned texts and typed numbers of usable rows; a projection and filters, no shuffle."""
    require_columns(raw, REVIEW_REQUIRED, "reviews")
    given = raw.na.drop(subset=["product_id", "rating", "review_text"])
    texts = with_values(
        given,
        review_title=clean_review_text(F.col("review_title"), entities),
        review_text=clean_review_text(F.col("review_text"), entities),
    ).where(F.col("review_text") != "")
    merged = with_values(texts, text=model_text(F.col("review_title"), F.col("review_text")))
    return (
        with_values(merged, text_len=token_count(F.col("text")))
        .where(F.col("text_len") >= min_tokens)
        .withColumn("rating", number_column(raw, "rating"))
        .withColumn("timestamp", int_column(raw, "timestamp"))
        .withColumn("helpful_vote", F.coalesce(int_column(raw, "helpful_vote"), F.lit(0).cast("bigint")))
        .withColumn("verified_purchase", flag_column(raw, "verified_purchase"))
        .where(F.col("rating").isNotNull())
    )


def keep_language(df: DataFrame, lang: str = "en", threshold: float = 0.90) -> DataFrame:
    """Rows a language model (columns ``detected_lang``, ``lang_conf``) surely assigns to ``lang``."""
    return df.where((F.col("detected_lang") == lang) & (F.col("lang_conf") >= threshold))


def join_meta(reviews: DataFrame, meta: DataFrame | None, order: list[Column | str] | None = None) -> DataFrame:
    """Product columns on every review; reviews without metadata stay. No metadata, no change.

    One metadata row per product meets many reviews: a small table is broadcast by its size at run time, a large
    one is sort-merge joined, where the runtime splits a skewed review partition.
    """
    if meta is None or "product_id" not in meta.columns:
        return reviews
    columns = [c for c in META_COLUMNS if c in meta.columns]
    one = keep_first(meta, ["product_id"], order or all_columns(meta))
    return reviews.join(one.select("product_id", *columns), "product_id", "left")


def clean_reviews(raw: DataFrame, meta: DataFrame | None = None, order: list[Column | str] = ("position",),
                  min_tokens: int = 3, entities: bool = True, language=None, lang_threshold: float = 0.90,
                  meta_order: list[Column | str] | None = None, sort: bool = True) -> DataFrame:
    """Clean, filter, deduplicate (first in ``order``), label, identify, add metadata, sort.

    ``language`` is a function adding ``detected_lang`` and ``lang_conf`` to the frame; only confident English stays.
    """
    df = clean_fields(raw, min_tokens, entities)
    extra = []
    if language is not None:
        df = keep_language(language(df), "en", lang_threshold)
        extra = ["detected_lang", "lang_conf"]
    df = keep_first(df, ["product_id", "rating", "review_text", "timestamp"], list(order))
    df = df.withColumn("sentiment_label", training_label(F.col("rating"))).withColumn(
        "review_id", review_hash(F.col("product_id"), F.col("rating"), F.col("timestamp"), F.col("review_text"))
    )
    df = df.select(
        "review_id", "product_id", "rating", "review_title", "review_text", "text", "sentiment_label", "timestamp",
        "helpful_vote", "verified_purchase", "text_len", *extra,
    )
    df = join_meta(df, meta, meta_order)
    if sort:
        df = df.orderBy(*[F.asc_nulls_last(c) for c in ("product_id", "timestamp", "review_id")])
    return df


def phase1_parts(cleaned: DataFrame, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Cleaned reviews with their ``split``; train and val together are the train_val rows that folds are made of.

    Counts, cuts and rows of splits and folds are a dozen passes over the reviews, so these are kept in the shared folder: texts are cleaned once.
    Callers that need no texts give reviews without them.
    """
    ensure_checkpoint_dir(cleaned.sparkSession)
    return stratified_split(cleaned.checkpoint(), test_size=test_size, val_size=val_size, seed=seed)


def phase1_folds(parts: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` over the train_val rows only: no test row is in a fold."""
    return stratified_folds(parts.where("split <> 'test'").drop("split"), folds=folds, seed=seed)


def stage_counts(tasks: DataFrame, records: DataFrame, errors: DataFrame, before: DataFrame, after: DataFrame, reviewed: DataFrame, meta: DataFrame) -> DataFrame:
    """Accounting of the other stages, one (stage, name, n) row per number: tasks written, skipped and failed; rows before and after the
    language filter; reviewed products with and without metadata."""
    def counted(df: DataFrame, stage: str, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "n")

    done, failed = records.select("product_id", "sentiment"), errors.select("product_id", "sentiment")
    ids = reviewed.select("product_id").where("product_id IS NOT NULL").distinct()
    held = meta.select("product_id").distinct()
    out = counted(records, "generation", "written")
    for df, stage, name in (
        (errors, "generation", "failed"), (tasks.join(done.unionByName(failed).distinct(), ["product_id", "sentiment"], "left_anti"), "generation", "skipped"),
        (before, "language", "before"), (after, "language", "kept"), (ids.join(held, "product_id", "left_semi"), "metadata", "matched"),
        (ids.join(held, "product_id", "left_anti"), "metadata", "missing"),
    ):
        out = out.unionByName(counted(df, stage, name))
    return out


def clean_counts(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Original and clean rows, products and rows per label."""
    before = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cleaned.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.countDistinct("product_id").alias("products"),
        *[F.count_if(F.col("sentiment_label") == s).alias(f"{s}_rows") for s in ("positive", "neutral", "negative")],
    ).withColumn("original_rows", before)
