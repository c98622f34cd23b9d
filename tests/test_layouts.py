"""Bucketed tables and their refresh, split files, strict JSON lines, first rows by a text, the evaluation record, and scans of the group plan."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF
from shelfsense.functions.coerce import int_or, number_or
from shelfsense.operators import evaluation, stats
from shelfsense.plans import chat, groups, ingest, insights
from shelfsense.plans.testviews import group_reviews
from shelfsense.session import scratch_path
from shelfsense.sources import readers, tables, writers
from shelfsense.streaming import streams

REVIEWS = "product_id string, n long"


def test_number_of_buckets_belongs_to_the_table(spark):
    root = scratch_path(spark, "buckets")
    assert tables.create_buckets(spark, root, 500) == 500 and tables.create_buckets(spark, root, 7) == 500
    rows = spark.createDataFrame([(f"p{i}", i) for i in range(900)] + [("hot", i) for i in range(3_000)], REVIEWS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else partitions this small are joined again
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tables.write_buckets(rows, root, "product_id", 1, slices=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    now = tables.current_buckets(spark, root)
    assert 350 < len(now) <= 500 and tables.read_buckets(spark, root).count() == 3_900
    hot = tables.touched_buckets(rows.where("product_id = 'hot'"), root, "product_id")
    assert len(hot) == 1
    per_file = tables.read_buckets(spark, root, hot).groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(per_file) >= 3 and max(r["count"] for r in per_file) < 2_000  # one hot bucket, several tasks
    with pytest.raises(ValueError):
        tables.create_buckets(spark, f"{root}-none", 0)


def test_small_batch_touches_few_files(spark):
    """After 400 products came, a batch of three reads and writes three buckets of 128, and the insights equal those of all reviews."""
    root, folder = scratch_path(spark, "refresh"), scratch_path(spark, "arrivals")
    seen = []

    def compute(reviews):
        seen.append(sorted({f.split("_bucket=")[1].split("/")[0] for f in reviews.inputFiles() if "/reviews/" in f}))
        return reviews.groupBy("product_id").agg(F.sum("n").cast("string").alias("payload")).select("product_id", F.lit("v").alias("model_version"), "payload", F.lit(0).alias("created_at"))

    batches = [[(f"p{i}", i) for i in range(400)], [("p1", 10), ("p2", 20), ("new", 5), (None, 1)], [("p1", 100)]]
    for rows in batches:
        spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").parquet(folder)
        source = streams.stream_files(spark, folder, spark.createDataFrame([], REVIEWS).schema)
        streams.refresh_insights(source, None, compute, root, buckets=128).awaitTermination()
    out = {r.product_id: r.payload for r in tables.read_buckets(spark, f"{root}/table").collect()}
    assert out == {**{f"p{i}": str(i) for i in range(400)}, "p1": "111", "p2": "22", "new": "5"}
    assert len(seen[0]) > 100 and len(seen[1]) <= 3 and len(seen[2]) == 1
    newest = tables.snapshots(spark, f"{root}/table")[-1]
    assert spark.read.parquet(newest).select("_bucket").distinct().count() == 1


def test_phase1_files(spark):
    root = scratch_path(spark, "phase1")
    parts = spark.createDataFrame([(f"r{i}", s) for i in range(30) for s in ("train", "val", "test")], "review_id string, split string")
    writers.write_phase1(parts, root)
    assert readers.read_table(spark, f"{root}/split=train/").count() == 30 if root.endswith(".parquet") else spark.read.parquet(f"{root}/split=train").count() == 30
    held = writers.read_train_val(spark, root)
    assert held.count() == 60 and not any("split=test" in f for f in held.where("review_id <> ''")._jdf.queryExecution().executedPlan().toString().split("\n") if "Location" in f and "PartitionFilters: []" in f)
    assert "PartitionFilters: [isnotnull(split" in held._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [split" in held._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("line, good", [('{"a": "1", "b": "x"}', True), ('  {"a": null}', True), ('[{"a": "1"}, {"a": "2"}]', False), ('"text"', False), ("{broken", False), ("", None)])
def test_json_lines_hold_one_object_each(spark, line, good):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([('{"a": "0"}',), (line,)], "value string").coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    if good is False:
        with pytest.raises(Exception):
            readers.read_jsonl(spark, path, schema).collect()
    else:
        assert readers.read_jsonl(spark, path, schema).count() == (2 if good else 1)
    assert readers.read_jsonl(spark, path, schema, tolerant=True).count() == (2 if good else 1)


def test_messages_come_back(spark):
    path = scratch_path(spark, "chat")
    rows = [("train", [("user", "q"), ("assistant", "a")]), ("test", [("user", "é\n"), ("assistant", None)])]
    df = spark.createDataFrame(rows, "split string, messages array<struct<role:string,content:string>>")
    writers.write_chat_splits(df, path)
    from shelfsense.schemas import MESSAGES

    back = readers.read_jsonl(spark, f"{path}/split=test", MESSAGES).collect()
    assert [[tuple(m) for m in r.messages] for r in back] == [rows[1][1]]
    assert not chat.validated(readers.read_jsonl(spark, f"{path}/split=test", MESSAGES)).first()["valid"]


@pytest.mark.parametrize("null_rows", [0, 3])
def test_first_rows_by_a_text(spark, null_rows):
    rng = random.Random(8)
    values = [f"product-{rng.randrange(10 ** 6):06d}" for _ in range(5_000)] + ["product-", "product-é"] + [None] * null_rows
    rng.shuffle(values)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "id string, at long").repartition(6)
    want = sorted(((v is not None, v or "", i) for i, v in enumerate(values)))[:40]
    got = [(r.id is not None, r.id or "", r["at"]) for r in ingest.leading_rows(df, ["id", "at"], 40).collect()]
    assert got == want
    plan = ingest.leading_rows(df, ["id", "at"], 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "conv(" in plan  # rows beyond the cut stay in their tasks
    one = spark.createDataFrame([("same", i) for i in range(50)], "id string, at long")
    assert [r["at"] for r in ingest.leading_rows(one, ["id", "at"], 5).collect()] == list(range(5))
    assert ingest.leading_rows(one.limit(0), ["id"], 5).count() == 0


def test_numbers_or_defaults(spark):
    values = ["3", " 2.5 ", "1e3", "x", None, "", "nan", "1e400", "-7"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(number_or(F.col("v"), 9.0).alias("f"), int_or(F.col("v"), 4).alias("i")).collect()
    assert [r.f for r in rows[:6]] == [3.0, 2.5, 1000.0, 9.0, 9.0, 9.0] and rows[-1].f == -7.0
    assert [r.i for r in rows[:6]] == [3, 2, 1000, 4, 4, 4] and rows[-1].i == -7 and all(r.i is not None and r.f is not None for r in rows)


def test_evaluation_record(spark):
    fields = evaluation.JUDGE_FIELDS
    rows = [(0.5, 0.25, *[4.0] * len(fields)), (0.0, 0.75, *[2.0] * len(fields)), (None, None, *[None] * len(fields))]
    df = spark.createDataFrame(rows, "r double, a double, " + ", ".join(f"{f} double" for f in fields))
    path = scratch_path(spark, "metrics")
    for judged in (True, False):
        writers.append_metrics(evaluation.evaluation_record(df, "r", "a", judged), path)
    records = [r.asDict(True) for r in spark.read.json(path).collect()]
    assert len(records) == 2 and {r["count"] for r in records} == {3} and {r["avg_rouge_l"] for r in records} == {0.25} and {r["avg_alignment_f1"] for r in records} == {0.5}
    full = next(r for r in records if r["llm_judge"])
    assert full["llm_judge"] == {f"avg_{f}": 3.0 for f in fields}


def test_job_and_summary_buckets(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 45.0), ("a", 200.0)], "k string, v double")
    for bounds in (stats.JOB_BUCKETS, stats.SUMMARY_BUCKETS):
        got = {r.le: r.bucket_count for r in stats.histogram(df, ["k"], "v", bounds).collect()}
        assert got == {**{repr(b): sum(v <= b for v in (0.05, 45.0, 200.0)) for b in bounds}, "+Inf": 3}


def test_insight_rows(spark):
    payload = spark.createDataFrame([("p", "v1", 3)], "product_id string, model_version string, total long")
    row = insights.insight_rows(payload, F.lit(7)).first()
    assert row.payload.asDict() == {"product_id": "p", "total": 3, "model_version": "v1"} and row.created_at == 7


def test_limited(spark):
    df = spark.range(10)
    assert [r.id for r in chat.limited(df, "id", 3).collect()] == [0, 1, 2]
    assert chat.limited(df, "id", None).count() == 10 and chat.limited(df, "id", 0).count() == 10


def test_group_plan_reads_texts_once_more_than_its_narrow_part(spark):
    wide = groups.product_groups(group_reviews(spark, SF), 6, 3, sort=False)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("FileScan")[1].split("]")[0] for line in plan.split("\n") if "FileScan" in line]
    assert sum("text#" in columns for columns in scans) == 1, plan
    assert math.isclose(wide.agg(F.sum("review_count")).first()[0], group_reviews(spark, SF).where("text <> ''").groupBy("product_id", "sentiment_label").count().where("count >= 3").agg(F.sum("count")).first()[0])
