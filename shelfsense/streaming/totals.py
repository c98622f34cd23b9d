"""Totals of all time from mergeable counts: each batch adds its own sums once, older ones are folded together now and then."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfsense.sources.tables import _files, snapshots, table_exists, write_snapshot

# So many batches stand beside the folded table before they are folded into it.
FOLD_BATCHES = 16


def _version(path: str) -> int:
    return int(path.rsplit("-", 1)[1])


def _merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def _state(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """The newest folded table (or none), and the batches after it."""
    folded = snapshots(spark, f"{root}/folded")[-1:]
    upto = _version(folded[0]) if folded else -1
    return folded, [p for p in snapshots(spark, f"{root}/batches") if _version(p) > upto]


def add_batch(sums: DataFrame, root: str, number: int, keys: list[str], fold: int = FOLD_BATCHES) -> None:
    """Add the sums of batch ``number`` (one row per key). A batch that comes again replaces its own sums, or changes nothing where they are folded already;
    a fold that did not finish is not read. A batch touches only its own keys; folding costs one pass over the totals every ``fold`` batches."""
    spark = sums.sparkSession
    folded, _ = _state(spark, root)
    if folded and _version(folded[0]) >= number:
        return
    write_snapshot(sums, f"{root}/batches", number)
    folded, batches = _state(spark, root)
    if len(batches) >= fold:
        write_snapshot(_merged([spark.read.parquet(p) for p in [*folded, *batches]], keys), f"{root}/folded", number)
        for old in [*snapshots(spark, f"{root}/folded")[:-2], *[p for p in snapshots(spark, f"{root}/batches") if _version(p) <= number - fold]]:
            fs, where = _files(spark, old)
            fs.delete(where, True)


def read_totals(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """Totals of everything added so far; None before the first batch."""
    folded, batches = _state(spark, root) if table_exists(spark, root) else ([], [])
    parts = [spark.read.parquet(p) for p in [*folded, *batches]]
    return _merged(parts, keys) if parts else None


def keep_totals(stream: DataFrame, keys: list[str], sums: Callable[[DataFrame], DataFrame], root: str, fold: int = FOLD_BATCHES) -> StreamingQuery:
    """Keep totals of ``stream``; ``sums`` makes one row per key of additive columns from a batch. No state and no window is kept, late rows count."""
    def add(batch: DataFrame, number: int) -> None:
        add_batch(sums(batch), root, number, keys, fold)

    return stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(add).start()
