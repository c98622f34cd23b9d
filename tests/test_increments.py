"""Stateful firsts, running totals, counts that come with a write, numbers from file places, the document sink and stored sketches."""

import datetime as dt
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfsense.operators.sketches import STANDARD_ERROR, distinct_sketches, merged_counts
from shelfsense.operators.skew import number_in_file_order
from shelfsense.plans.accounting import Accounting
from shelfsense.session import scratch_path
from shelfsense.sources.documents import DocumentSink, read_documents, write_documents
from shelfsense.streaming import first_seen, streams, totals


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def write_in_order(spark, folder, batches, schema):
    """One file per batch, their times ascending, so that a stream takes them in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        names = [f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet")]
        newest = max(names, key=os.path.getmtime) if i else names[0]
        for n in names:
            if n == newest:
                os.utime(n, (1_700_000_000 + i, 1_700_000_000 + i))


EVENTS = "k string, id string, t timestamp, v long"


def test_late_earlier_rows_win_and_state_expires(spark):
    folder = scratch_path(spark, "first")
    batches = [
        [("a", "2", at(60), 1), ("b", "5", at(61), 2), (None, "1", at(60), 3), ("a", "9", None, 4)],
        [("a", "3", at(40), 5), ("b", "4", at(61), 6), ("b", "6", at(62), 7)],       # an earlier time, an earlier id at the same time, a later row
        [("c", "1", at(2_000), 8)],                                                    # moves the watermark past a and b
        [("d", "1", at(2_001), 9), ("e", "1", at(2_002), 10)],
    ]
    write_in_order(spark, folder, batches, EVENTS)
    source = streams.stream_files(spark, folder, spark.createDataFrame([], EVENTS).schema, files_per_batch=1)
    first = first_seen.first_by_time(source, ["k"], "t", "id", "100 minutes")
    root, progress = scratch_path(spark, "first-out"), []

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = first.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.stateOperators]
    out = streams.latest(spark.read.parquet(f"{root}/out"), ["k"])
    assert {r.k: (r.id, r.v) for r in out.collect()} == {"a": ("3", 5), "b": ("4", 6), None: ("1", 3), "c": ("1", 8), "d": ("1", 9), "e": ("1", 10)}
    removed = [p.stateOperators[0].numRowsRemoved for p in progress]
    assert sum(removed) >= 3, removed  # a, b and the null key left the state


def test_first_of_a_key_outlives_its_state(spark):
    folder = scratch_path(spark, "first")
    batches = [[("a", "2", at(60), 1), ("b", "1", at(50), 2)], [("c", "1", at(5_000), 3)], [("a", "1", at(5_001), 4), ("b", "0", at(4_990), 5)], [("c", "0", at(4_950), 6)]]
    write_in_order(spark, folder, batches, EVENTS)
    source = streams.stream_files(spark, folder, spark.createDataFrame([], EVENTS).schema, files_per_batch=1)
    first = first_seen.first_by_time(source, ["k"], "t", "id", "100 minutes")
    assert "python" not in first._jdf.queryExecution().analyzed().toString().lower()  # no call of Python for each key
    out = streams.run_available(first, "update")
    found = first_seen.earliest(out, ["k"], "t", "id").collect()
    assert {r.k: (r.id, r.v) for r in found} == {"a": ("2", 1), "b": ("1", 2), "c": ("0", 6)}


def test_totals_add_every_batch_once(spark):
    root = scratch_path(spark, "totals")
    want = Counter()
    assert totals.read_totals(spark, root, ["k"]) is None
    for number in range(10):
        rows = [("x", 1), (f"k{number % 3}", number), (None, 2)]
        for k, n in rows:
            want[k] += n
        sums = spark.createDataFrame(rows, "k string, n long")
        totals.add_batch(sums, root, number, ["k"], fold=4)
        if number in (1, 3, 9):
            totals.add_batch(sums, root, number, ["k"], fold=4)  # the batch comes again, before and after it was folded
        assert {r.k: r.n for r in totals.read_totals(spark, root, ["k"]).collect()} == dict(want)
    totals.add_batch(spark.createDataFrame([("x", 99)], "k string, n long"), root, 2, ["k"], fold=4)  # folded long ago: changes nothing
    assert {r.k: r.n for r in totals.read_totals(spark, root, ["k"]).collect()} == dict(want)
    _, beside = totals._state(spark, root)
    assert len(beside) < 4


def test_totals_of_a_stream(spark):
    folder, root = scratch_path(spark, "in"), scratch_path(spark, "totals")
    write_in_order(spark, folder, [[("a", 1), ("b", 2)], [("a", 3)], [("c", 4), ("a", 5)]], "k string, n long")
    for _ in range(2):  # the second run finds nothing new
        source = streams.stream_files(spark, folder, spark.createDataFrame([], "k string, n long").schema, files_per_batch=1)
        totals.keep_totals(source, ["k"], lambda b: b.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")), root, fold=2).awaitTermination()
        assert {(r.k, r.n, r.c) for r in totals.read_totals(spark, root, ["k"]).collect()} == {("a", 9, 3), ("b", 2, 1), ("c", 4, 1)}


def test_accounting_scans_once(spark):
    source = scratch_path(spark, "source")
    spark.range(1_000).write.parquet(source)
    book = Accounting()
    raw = book.at(spark.read.parquet(source), "raw", even=F.col("id") % 2 == 0)
    kept = book.at(raw.where("id % 3 = 0"), "kept", low=F.col("id") < 30)
    grouped = book.at(kept.groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    grouped.write.parquet(scratch_path(spark, "out"))
    assert book.rows() == [("raw", "rows", 1_000), ("raw", "even", 500), ("kept", "rows", 334), ("kept", "low", 10), ("grouped", "rows", 7)]


def test_numbers_follow_files_and_move_no_row(spark):
    folder = scratch_path(spark, "files")
    for i in range(5):
        spark.range(i * 1_000, i * 1_000 + 700 + i).select("id", F.repeat(F.lit("x"), 200).alias("text")).coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several pieces a file, several files a task
    try:
        numbered = number_in_file_order(spark.read.parquet(folder), F.col("id") % 3 != 0, "n")
        rows = numbered.collect()
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = {r.id: r.file for r in spark.read.parquet(folder).select("id", F.col("_metadata.file_path").alias("file")).collect()}
    want = sorted((i for i in files if i % 3), key=lambda i: (files[i], i))
    assert [r.id for r in sorted(rows, key=lambda r: r.n)] == want and sorted(r.n for r in rows) == list(range(1, len(want) + 1))
    top = plan[plan.index("BroadcastHashJoin"):plan.index("FileScan")]
    assert "Exchange hashpartitioning" not in top and "Exchange rangepartitioning" not in plan


def test_documents_are_all_there_or_none(spark):
    root = scratch_path(spark, "docs")
    docs = spark.createDataFrame([(f"p{i}.json", f'{{"i": {i}, "t": "é\\n"}}') for i in range(200)], "file_name string, document string").repartition(5)
    write_documents(docs, root)
    assert {(r.file_name, r.document) for r in read_documents(spark, root).collect()} == {(r.file_name, r.document) for r in docs.collect()}
    bad = docs.unionByName(spark.createDataFrame([("no/name.json", "{}")], docs.schema))
    with pytest.raises(Exception):
        write_documents(bad.withColumn("document", F.lit("changed")), root)
    with pytest.raises(Exception):
        write_documents(docs.unionByName(docs.limit(1)), root)
    assert read_documents(spark, root).where("document = 'changed'").count() == 0 and read_documents(spark, root).count() == 200
    assert not [n for n in os.listdir(root) if n.startswith("_staging")]
    write_documents(docs.limit(3), root)  # replaces all
    assert read_documents(spark, root).count() == 3
    write_documents(docs.where("file_name = 'p7.json'"), root, "append")
    assert read_documents(spark, root).count() in (3, 4)
    with pytest.raises(ValueError):
        DocumentSink({"path": root}).writer(spark.range(1).schema, True)


def test_sketches_merge_over_runs(spark):
    rows = spark.range(60_000).select((F.col("id") % 9).alias("run"), (F.col("id") % 20_000).alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") * 7) % 333).alias("b"))
    held = distinct_sketches(rows, ["run"], {"a": F.col("a"), "b": F.col("b")})
    got = {r.name: r.estimate for r in merged_counts(held).collect()}
    assert abs(got["a"] - 20_000) <= 3 * STANDARD_ERROR * 20_000 and abs(got["b"] - 333) <= max(1, 3 * STANDARD_ERROR * 333)
    by_run = {(r.run, r.name): r.estimate for r in merged_counts(held, ["run"]).collect()}
    exact = {r.run: r.n for r in rows.groupBy("run").agg(F.countDistinct("a").alias("n")).collect()}
    assert all(abs(by_run[run, "a"] - n) <= 3 * STANDARD_ERROR * n for run, n in exact.items())
