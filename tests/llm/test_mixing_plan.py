"""What the plan of the mix must not do."""

from pyspark.sql import functions as F

from shelfsense.llm import mixing


def test_drawn_slots_are_not_broadcast(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("word"), 300)).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    sizes = mixing.count_words(docs, "doc_id", "text", "source")
    words = mixing.drawn_words(sizes, mixing.saved(mixing.source_plan(sizes), "plan"))
    words.collect()
    plan = words._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joined = next(line for line in plan.splitlines() if "Join" in line and "block" in line)
    assert "SortMergeJoin" in joined, joined
