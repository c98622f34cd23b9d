"""What of whole texts stands in a task at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfsense.llm import common, factor_machine

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("step", ["map_texts", "saved", "keep_quality"])
def test_batches_of_large_texts_are_small(spark, step):
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield batch.select(["doc_id"]).slice(0, 1).append_column("n", pa.array([batch.nbytes])) if batch.num_rows else batch

    spark.conf.unset(LIMIT)
    if step == "map_texts":
        common.map_texts(docs, "doc_id", "text", "n long", lambda: lambda texts: {"n": [len(t) for t in texts]})
    elif step == "saved":
        common.saved(docs.limit(1), "one")
    else:
        factor_machine.keep_quality(docs, factor_machine.fit([], None))
    found = [r.n for r in docs.mapInArrow(sizes, "doc_id long, n long").collect()]
    assert sum(found) > 20_000_000 * 0.9 and max(found) < 8 << 20, found


def test_a_given_limit_stays(spark):
    spark.conf.set(LIMIT, "1m")
    common.bound_batches(spark)
    assert spark.conf.get(LIMIT) == "1m"
    spark.conf.unset(LIMIT)
