"""What Python workers hold at once."""

import random
import resource

import pyarrow as pa
from pyspark.sql import functions as F

from shelfsense.llm import common, jaccard_join, mixing


def test_parts_of_a_long_text_do_not_carry_it_whole(spark):
    """300,000 words are 2,344 blocks; the whole text for each of them is 5 GB."""

    def peak(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], ["mb"])

    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.format_string("w%06d", i)))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), long.alias("text"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    rows = mixing.mixed_blocks(docs).select("text", "n_chars").collect()
    assert len(rows) == 2_344 and all(r.n_chars == len(r.text) for r in rows)
    assert sorted(w for r in rows for w in r.text.split()) == [f"w{i:06d}" for i in range(1, 300_001)]
    assert max(r.mb for r in spark.range(0, 64, 1, 64).mapInArrow(peak, "mb long").collect()) < 2_500


def test_the_cache_of_words_stays_small():
    words, most = jaccard_join.Words(), 0
    for i in range(250_000):
        words[b"%d" % i]
        most = max(most, len(words))
    assert most <= 100_000 and words[b"7"] == jaccard_join.Words()[b"7"]


def test_no_stage_of_near_dedup_runs_two_functions(spark, monkeypatch):
    """Between two Python functions a plan has an exchange, or one ends in a table: a task has one worker."""
    monkeypatch.setattr(jaccard_join, "TILE", 6000)
    plans, write = [], common.saved

    def saved(df, name, *rows):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *rows)

    monkeypatch.setattr(common, "saved", saved)
    monkeypatch.setattr(jaccard_join, "saved", saved)
    rng, rows = random.Random(6), []
    first = [f"w{i}" for i in range(200)]
    for i in range(60):
        at = rng.randrange(200)
        rows.append((i, " ".join([*first[:at], f"x{i}", *first[at + 1:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_components(docs, 3, 80, 100).collect()} == {0}
    assert "references" in {name for name, _ in plans}
    for name, plan in plans:
        above = []  # depth of each function over this line, none where an exchange lies between
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            while above and above[-1][0] >= depth:
                above.pop()
            if "MapInArrow" in line:
                assert not (above and above[-1][1]), (name, plan)
                above.append((depth, True))
            elif "Exchange" in line or "InMemory" in line:
                above.append((depth, False))
