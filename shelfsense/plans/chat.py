"""From product records to summary tasks, generated records, chat messages and their splits."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.ids import prompt_hash, request_key
from shelfsense.functions.prompts import dataset_prompt, last_of_role, messages_valid, to_messages
from shelfsense.functions.text import collapse, distinct_texts, strip
from shelfsense.operators.splits import group_split
from shelfsense.schemas import CHAT_DATASET, CHAT_ERRORS, SENTIMENTS, cast_to, require_columns
from shelfsense.session import scratch_path
from shelfsense.sources.tables import table_exists


def item_texts(items: Column) -> Column:
    """An item's text, or its review text when blank."""
    return F.transform(items, lambda i: collapse(F.coalesce(F.nullif(i["text"], F.lit("")), i["review_text"], F.lit(""))))


def present_sentiments(df: DataFrame) -> Column:
    """How many sentiments of the record have reviews."""
    def has(s: str) -> Column:
        sizes = [F.coalesce(F.array_size(f"{s}_{kind}"), F.lit(0)) for kind in ("review_items", "reviews") if f"{s}_{kind}" in df.columns]
        return (F.greatest(*sizes, F.lit(0)) > 0).cast("int")

    return has(SENTIMENTS[0]) + has(SENTIMENTS[1]) + has(SENTIMENTS[2])


def summary_tasks(groups: DataFrame, top_k: int = 5, min_sentiments: int = 1, max_products: int | None = None,
                  order: list[Column | str] | None = None) -> DataFrame:
    """One task per product and sentiment that has reviews. A projection of the records: no shuffle
    unless ``max_products`` takes the first records in ``order``."""
    if max_products is not None:
        groups = groups.orderBy(*(order or [F.desc("review_count"), "product_id"])).limit(max_products)
    kept = groups.where(present_sentiments(groups) >= min_sentiments)
    parts = []
    for s in SENTIMENTS:
        items, texts = F.col(f"{s}_review_items"), F.col(f"{s}_reviews")
        from_items = F.coalesce(F.array_size(items), F.lit(0)) > 0
        chosen = distinct_texts(F.when(from_items, item_texts(items)).otherwise(F.coalesce(texts, F.array().cast("array<string>"))))
        parts.append(F.struct(
            F.lit(s).alias("sentiment"),
            F.slice(chosen, 1, top_k).alias("selected_reviews"),
            F.when(from_items, F.array_size(items)).otherwise(F.coalesce(F.array_size(texts), F.lit(0))).alias("original_sentiment_count"),
        ))
    long = kept.select("product_id", "product_title", "main_category", F.inline(F.array(*parts))).where(F.size("selected_reviews") > 0)
    return long.withColumn(
        "prompt", dataset_prompt(F.col("product_title"), F.col("main_category"), F.col("sentiment"), F.col("selected_reviews"))
    ).withColumn("request_key", request_key(F.col("product_id"), F.col("sentiment")))


def remaining_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks whose (product, sentiment) is not finished yet."""
    return tasks.join(done.select("product_id", "sentiment").distinct(), ["product_id", "sentiment"], "left_anti")


_ANSWER = T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType()), T.StructField("latency_ms", T.DoubleType())])


def generate(df: DataFrame, prompt: str, function: Callable[[str], str], keys: list[str], path: str | None = None, waves: int = 1,
             threads: int = 8, rows: int = 64) -> DataFrame:
    """Call a text generator once per row in the tasks and keep the answers: the rows with ``result``, ``error`` (NULL when it worked)
    and ``latency_ms``, read from storage, so that no later reader calls again.

    ``keys`` name a row. With a ``path`` the answers stay there, and rows whose keys it holds are not called again; each of ``waves``
    (a hash of the keys) is stored before the next begins, so a stopped run resumes after its last wave. Inside a task ``threads`` calls run
    at a time over ``rows`` rows. A row that repeats the keys of another is not called. Runs jobs.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "generated")
    schema = T.StructType([*df.schema.fields, *_ANSWER.fields])

    def call(text: str | None) -> tuple:
        start = time.perf_counter()
        try:
            result, error = function(text), None
        except Exception as exc:  # noqa: BLE001 - one failed row must not end the job
            result, error = None, str(exc)
        return result, error, round((time.perf_counter() - start) * 1000, 2)

    at = df.columns.index(prompt)

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    answers = list(zip(*pool.map(call, part.column(at).to_pylist())))
                    kinds = (pa.string(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(a, k) for a, k in zip(answers, kinds)]], schema.names)

    todo = df.dropDuplicates(keys)
    if table_exists(spark, path):
        todo = todo.join(spark.read.schema(schema).parquet(path).select(*keys), keys, "left_anti")
    for wave in range(waves):
        share = todo.where(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave) if waves > 1 else todo
        share.mapInArrow(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def summary_records(generated: DataFrame, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Split generated tasks (the stored rows of ``generate``) into finished records and errors."""
    named = (
        generated.withColumn("source_reviews", F.col("selected_reviews"))
        .withColumn("source_review_count", F.size("selected_reviews"))
        .withColumn("prompt_hash", prompt_hash(F.col("prompt")))
        .withColumn("gold_summary", strip(F.col("result")))
        .withColumn("generator_provider", F.lit(provider))
        .withColumn("generator_model", F.lit(model))
    )
    return cast_to(named.where(F.col("error").isNull()), CHAT_DATASET), cast_to(named.where(F.col("error").isNotNull()), CHAT_ERRORS)


def usable_records(records: DataFrame) -> DataFrame:
    """Records whose product, prompt and summary are not blank, trimmed."""
    require_columns(records, ["product_id", "sentiment", "prompt", "gold_summary"], "records")
    kept = records.select("product_id", *[strip(F.col(c)).alias(c) for c in ("sentiment", "prompt", "gold_summary")])
    return kept.where((F.col("product_id") != "") & (F.col("prompt") != "") & (F.col("gold_summary") != ""))


def chat_messages(records: DataFrame) -> DataFrame:
    return records.select(*records.columns, to_messages(F.col("prompt"), F.col("gold_summary")).alias("messages"))


def chat_splits(records: DataFrame, test_size: float = 0.2, val_fraction_of_temp: float = 0.5, seed: int = 42) -> DataFrame:
    """Usable records as messages with a ``split`` that keeps each product in one part."""
    return chat_messages(group_split(usable_records(records), "product_id", test_size, val_fraction_of_temp, seed))


def conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turn rows to one message list per conversation, for training examples, which fit a row by definition. ``turn_facts`` gives the
    same facts for conversations of any length without a list."""
    return turns.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(order, "role", F.col("text").alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )


def turn_facts(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation, straight from turn rows of any number: message count, validity, last user and last assistant
    text, and what is missing. All partial aggregates."""
    content = strip(F.col("text"))
    whole = F.coalesce(F.col("role").isNotNull() & (content != ""), F.lit(False))

    def last(role: str) -> Column:
        return F.max_by(content, F.when(F.col("role") == role, F.col(order)))

    facts = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"), F.every(whole).alias("_whole"),
        last("user").alias("prompt"), last("assistant").alias("reference_answer"),
    )
    return facts.withColumn("valid", F.col("_whole") & (F.col("messages") >= 2)).withColumn("problem", _missing_turn()).drop("_whole")


def _missing_turn() -> Column:
    return F.when(F.col("prompt").isNull(), "no user turn").when(F.col("reference_answer").isNull(), "no assistant turn")


def validated(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", messages_valid(F.col("messages")))


def invalid_examples(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` ids of invalid examples."""
    return validated(df).where(~F.col("valid")).select(key).orderBy(key).limit(n)


def prompt_and_reference(df: DataFrame, strict: bool = False) -> DataFrame:
    """Last user and last assistant text of each conversation; ``strict`` fails where one is missing, otherwise
    ``problem`` names it."""
    prompt, reference = last_of_role(F.col("messages"), "user"), last_of_role(F.col("messages"), "assistant")
    out = df.withColumn("prompt", prompt).withColumn("reference_answer", reference).withColumn("problem", _missing_turn())
    if strict:
        out = out.withColumn("prompt", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("prompt")))
    return out


def predictions(pairs: DataFrame, generator: Callable[[str], str], keys: list[str], path: str | None = None) -> DataFrame:
    """Reference and generated answer side by side, with the call's latency."""
    return generate(pairs, "prompt", generator, keys, path).withColumnRenamed("result", "generated_answer")


def limited(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` examples in a defined order; all without a positive ``n``."""
    return df.orderBy(order).limit(n) if n and n > 0 else df
