"""Reading, writing, upserts and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF
from shelfsense import schemas
from shelfsense.plans import chat, ingest
from shelfsense.sources import readers, tables, writers
from shelfsense.streaming import streams


def test_jsonl_review_scan(spark, tmp_path):
    rows = [
        {"parent_asin": " A1 ", "rating": 5, "title": None, "text": " ok ", "timestamp": 1588687728923, "helpful_vote": 2, "verified_purchase": True, "images": [{"large": "u"}], "other": 1},
        {"parent_asin": "A2", "rating": "bad", "text": "x"}, {"parent_asin": "A3", "rating": 4.0, "text": "  "},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in rows))
    typed = ingest.typed_reviews(readers.read_source_reviews(spark, str(path)))
    assert typed.schema == schemas.RAW_REVIEWS
    got = typed.collect()
    assert len(got) == 1 and got[0]["product_id"] == "A1" and got[0]["verified_purchase"] is True and json.loads(got[0]["images"]) == [{"large": "u"}]
    path.write_text('{"parent_asin": "A1"}\n{broken')
    with pytest.raises(Exception):
        readers.read_source_reviews(spark, str(path)).collect()


def test_tolerant_keys(spark, tmp_path):
    path = tmp_path / "k.jsonl"
    path.write_text('{"product_id": "a", "sentiment": "positive"}\nnot json\n{"product_id": "a", "sentiment": "positive"}\n')
    assert [tuple(r) for r in readers.finished_keys(spark, str(path)).collect()] == [("a", "positive")]


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    schema = schemas.struct_of("product_id string, review_text string")
    df = spark.createDataFrame([("a", 'two\nlines, "quoted"'), ("b", "plain")], schema)
    writers.write_csv(df, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / "t.csv"), schema).collect())) == sorted(map(tuple, df.collect()))
    assert readers.sample_is_complete(spark, str(tmp_path / "t.csv"), schema, 3) is None
    assert readers.sample_is_complete(spark, str(tmp_path / "t.csv"), schema, 2).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "x.orc")


def test_empty_parquet_keeps_schema(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.RAW_REVIEWS)
    writers.write_parquet(empty, str(tmp_path / "e.parquet"), schemas.RAW_REVIEWS)
    assert readers.read_table(spark, str(tmp_path / "e.parquet")).schema == schemas.RAW_REVIEWS


def test_splits_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, [1]), ("test", 2, [2])], "split string, x int, l array<int>")
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=test")).count() == 1
    writers.write_statistics(df, str(tmp_path / "c.csv"))
    assert "l" not in spark.read.option("header", True).csv(str(tmp_path / "c.csv")).columns
    writers.append_metrics(df.select("x"), str(tmp_path / "m"))
    writers.append_metrics(df.select("x"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4


def test_insert_absent_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, pos int")
    for _ in range(2):
        tables.insert_absent(df, spark, str(tmp_path / "t"), "id", ["pos"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("a", 1), ("b", 3)]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_snapshot(spark, root) is None
    tables.write_snapshot(spark.range(3), root, 1)
    tables.write_snapshot(tables.read_snapshot(spark, root).where("id > 0"), root, 2)
    tables.write_snapshot(spark.range(9).where("id > 6"), root, 2)
    assert tables.read_snapshot(spark, root).count() == 2 and len(tables.snapshots(spark, root)) == 2


def test_review_stream_drops_repeats(spark, tmp_path):
    row = {"parent_asin": "A", "rating": 4, "text": "good", "timestamp": 1588687728923}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in [row, row, {**row, "text": "other"}, {**row, "rating": None}]))
    stream = streams.review_stream(streams.stream_files(spark, str(folder), schemas.SOURCE_REVIEWS_JSON, "json"))
    out = streams.run_available(stream, "append", str(tmp_path / "out"))
    assert sorted(r["review_text"] for r in out.collect()) == ["good", "other"]
    (folder / "2.json").write_text(json.dumps(row))
    assert streams.run_available(stream, "append", str(tmp_path / "out")).count() == 2


def test_refresh_touches_only_arrived_products(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    schema = schemas.struct_of("product_id string, n bigint")
    table = lambda: spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema)
    calls = []

    def compute(reviews):
        calls.append(sorted(r[0] for r in reviews.select("product_id").collect()))
        return reviews.select("product_id", F.lit("v").alias("model_version"), F.col("n").alias("payload"), F.lit(len(calls)).alias("created_at"))

    for i, ids in enumerate([["a"], ["a", "b"]]):
        spark.createDataFrame([(x, 0) for x in ids], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = streams.stream_files(spark, str(folder), schema)
        streams.refresh_insights(stream, table, compute, root).awaitTermination()
    out = {r["product_id"]: r["created_at"] for r in tables.read_buckets(spark, f"{root}/table").collect()}
    assert calls == [["a"], ["a", "b"]] and out == {"a": 1, "b": 2}


def test_texts_are_spread_only_on_demand(spark):
    from shelfsense.plans.testviews import texts

    assert texts(spark, SF, "documents", "doc_id").rdd.getNumPartitions() == 1
    spark.conf.set("shelfsense.text.tasks", "3")
    try:
        assert texts(spark, SF, "documents", "doc_id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("shelfsense.text.tasks")


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.createDataFrame([(f"p{i}", 1) for i in range(200)], "product_id string, n int")
    tables.write_buckets(rows, root, "product_id", 1)
    first = tables.current_buckets(spark, root)
    one = rows.where("product_id = 'p7'").select(tables.bucket_of("product_id")).first()[0]
    changed = tables.read_buckets(spark, root, [one]).withColumn("n", F.lit(2))
    for version in (2, 3, 4):
        tables.write_buckets(changed, root, "product_id", version)
    now = tables.current_buckets(spark, root)
    assert {b for b in now if now[b] != first[b]} == {one}
    assert tables.read_buckets(spark, root, before=2).agg(F.sum("n")).first()[0] == 200
    out = tables.read_buckets(spark, root)
    assert out.count() == 200 and out.where("n = 2").count() == changed.count()
    assert tables.drop_superseded(spark, root, keep=3) == [first[one]] and tables.current_buckets(spark, root) == now


def test_generation_calls_once_and_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def answer(text):
        import uuid

        (calls / f"{text}-{uuid.uuid4().hex}").touch()
        if text.endswith("3"):
            raise ValueError("declined")
        return text.upper()

    tasks = spark.createDataFrame([(f"p{i}", "neutral", f"t{i}") for i in range(20)], "product_id string, sentiment string, prompt string").withColumn(
        "selected_reviews", F.array("prompt"))
    path = str(tmp_path / "answers")
    keys = ["product_id", "sentiment"]
    chat.generate(tasks.where("product_id < 'p15'"), "prompt", answer, keys, path, waves=2)
    made = chat.generate(tasks, "prompt", answer, keys, path)
    done, failed = chat.summary_records(made, "local", "echo")
    writers.append_records(done, failed, str(tmp_path / "done"), str(tmp_path / "failed"))
    writers.append_records(done.limit(0), failed.limit(0), str(tmp_path / "done"), str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "done")).count() == 18 and spark.read.json(str(tmp_path / "failed")).count() == 2
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == sorted(f"t{i}" for i in range(20))
