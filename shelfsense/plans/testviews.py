"""The given test tables seen as reviews and product metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.functions.coerce import datetime_to_millis
from shelfsense.functions.text import token_count
from shelfsense.operators.bind import with_values

BASE_MILLIS = 1577836800000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of long texts, read as it lies. Where the session sets ``shelfsense.text.tasks``, as a run on one small file may, it is
    spread over so many tasks by id."""
    df, tasks = table(spark, sf_dir, name), spark.conf.get("shelfsense.text.tasks", None)
    return df.repartition(int(tasks), key) if tasks else df


def doc_reviews(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents as reviews: the source is the product, labels give ratings, some rows carry a label already. ``docs`` may be given, with
    columns ``keep`` to carry along."""
    docs, labels = texts(spark, sf_dir, "documents", "doc_id") if docs is None else docs, table(spark, sf_dir, "labels")
    rating = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 5.0)
        .when(F.col("quality") == 1, 3.0)
        .when(F.col("quality") == 0, F.when(F.col("doc_id") % 5 == 0, 2.5).otherwise(1.0))
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("position"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("review_id"),
        F.col("source").alias("product_id"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.col("lang"), F.lit(" review!"))).alias("review_title"),
        F.col("text").alias("review_text"),
        F.length("text").alias("review_char_len"),
        rating.alias("rating"),
        (F.col("n_chars") % 17).alias("helpful_vote"),
        (F.col("doc_id") % 3 != 0).alias("verified_purchase"),
        F.when(F.col("n_chars") % 97 != 0, F.lit(BASE_MILLIS) + (F.col("n_chars") % 1000) * 3600000).alias("timestamp"),
        F.when(F.col("doc_id") % 12 == 0, " Negative ").when(F.col("doc_id") % 12 == 1, "neutral")
        .when(F.col("doc_id") % 12 == 2, "great").alias("predicted_sentiment"),
        F.when(F.col("doc_id") % 12 <= 2, (F.col("n_chars") % 150) / 100.0).alias("sentiment_confidence"),
        F.when(F.col("doc_id") % 6 == 0, "[]").when(F.col("doc_id") % 6 == 1, " ")
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("http://img/"), F.col("doc_id").cast("string"))).alias("images"),
        F.col("lang"), *keep,
    )


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def fact_reviews(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Order lines as ratings of parts; ``keep`` names the line columns to carry along."""
    rating = ((F.col("l_linenumber") - 1) % 5 + 1).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"),
        rating.alias("rating"),
        F.col("l_quantity").cast("bigint").alias("helpful_vote"),
        (F.col("l_returnflag") == "N").alias("verified_purchase"),
        datetime_to_millis(F.col("l_shipdate")).alias("timestamp"),
        (F.col("l_extendedprice").cast("bigint") % 400).cast("int").alias("text_len"),
        F.when(rating >= 4, "positive").when(rating == 3, "neutral").otherwise("negative").alias("sentiment_label"),
        *keep,
    )


def part_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as product metadata, list fields as texts of several shapes."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        key.cast("string").alias("product_id"),
        F.when(key % 50 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("product_title"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("main_category"),
        F.when(key % 9 != 0, F.concat(F.lit("$"), key.cast("string"))).alias("price"),
        F.when(key % 7 != 0, (F.col("p_size") % 50) / 10.0).alias("average_rating"),
        F.when(key % 11 != 0, F.col("p_size").cast("bigint")).alias("rating_number"),
        F.when(key % 5 == 0, F.concat(F.lit('["'), F.col("p_type"), F.lit('", " ", "'), F.col("p_brand"), F.lit('"]')))
        .when(key % 5 == 1, F.concat(F.lit("['"), F.col("p_type"), F.lit("', 'x']")))
        .when(key % 5 == 2, "[]").when(key % 5 == 3, F.col("p_name")).alias("categories"),
        F.when(key % 4 == 0, F.concat(F.lit('["size '), F.col("p_size").cast("string"), F.lit('","'), F.col("p_brand"), F.lit('"]'))).alias("features"),
        F.when(key % 3 == 0, F.col("p_name")).alias("description"),
        F.when(key % 6 == 0, F.concat(F.lit("https://img/"), key.cast("string"), F.lit(".jpg")))
        .when(key % 6 == 1, F.concat(F.lit('["x", "https://img/'), key.cast("string"), F.lit('-a.jpg"]')))
        .when(key % 6 == 2, F.concat(F.lit('[{"thumb": "https://img/'), key.cast("string"), F.lit('-t.jpg", "large": null}]')))
        .when(key % 6 == 3, "[]").when(key % 6 == 4, "no image").alias("images"),
    )


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the document sources, from the documents themselves."""
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min("lang").alias("lang"), F.count(F.lit(1)).alias("n")
    ).select(
        F.col("source").alias("product_id"), F.concat(F.lit("Source "), F.col("source")).alias("product_title"),
        F.lit("library").alias("store"), F.col("lang").alias("main_category"), null.alias("price"),
        F.lit(None).cast("double").alias("average_rating"), F.col("n").alias("rating_number"), null.alias("categories"),
        null.alias("features"), null.alias("description"), null.alias("images"),
    )


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as loosely typed source records with every kind of bad value."""
    at = F.col("doc_id")

    def pick(by: int, *values: str | None):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            out = F.when(at % by == i, F.lit(v)).otherwise(out)
        return out

    return texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        F.when(at % 13 == 0, "  ").when(at % 13 != 1, F.concat(F.lit(" "), F.col("source"), F.lit("\t"))).alias("parent_asin"),
        pick(7, "5", "4.0", " $3.5 ", "1,000", "bad", None, "").alias("rating"),
        F.col("lang").alias("title"),
        F.when(at % 10 == 0, " \n ").otherwise(F.col("text")).alias("text"),
        pick(6, "1588687728923", "1588687728923.0", "x", None, "-4.7", "1e3").alias("timestamp"),
        pick(5, "3", "2.9", "", None, "-1").alias("helpful_vote"),
        pick(8, "true", "1", " Yes", "n", "FALSE", "maybe", None, "2").alias("verified_purchase"),
        F.lit("[]").alias("images"),
    )


def group_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document reviews in the form of the cleaned table."""
    reviews = with_values(doc_reviews(spark, sf_dir), text_len=token_count(F.col("review_text")))
    label = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") == 3, "neutral").when(
        F.col("rating").isNotNull(), "negative").otherwise("positive")
    return reviews.select(
        "review_id", "product_id", "review_title", "review_text", F.col("review_text").alias("text"),
        F.coalesce("rating", F.lit(4.0)).alias("rating"), "timestamp", "helpful_vote",
        F.col("verified_purchase").cast("int").alias("verified_purchase"), "text_len",
        label.alias("sentiment_label"), F.concat(F.lit("Source "), F.col("product_id")).alias("product_title"),
        F.when(F.col("product_id") != "src3", F.lit("Texts")).alias("main_category"),
    )
