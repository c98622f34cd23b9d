"""Helpers shared by the operators: Arrow scans, fresh names, salted joins, running totals, register-blocked Bloom filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.session import shared_dir

# Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
# Longer words and pieces are not remembered by the workers' caches, whose entries are counted and so bounded in bytes too.
REMEMBERED_BYTES = 64
# What an explicitly broadcast side may take, computed from its row count before it is broadcast.
BROADCAST_BYTES = 64 << 20
# What an Arrow batch takes, about. Spark's 64 MB of whole texts or sets stand several times over in a task: while the batch grows, as it is sent, in the worker.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session stay within ARROW_BYTES, or within the limit that it was given."""
    if _ARROW_LIMIT not in spark.conf.getAll:
        spark.conf.set(_ARROW_LIMIT, ARROW_BYTES)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(docs: DataFrame, doc_id: str, text: str, schema: str, make: Callable[[], Callable[[list[bytes]], dict]],
              keep: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep`` (new name to column) and columns computed from each whole text; ``make()`` runs once
    per task and gives a function from UTF-8 texts (null is empty) to Arrow-ready columns. Other columns are not read."""
    bound_batches(docs.sparkSession)
    kept = {"doc_id": doc_id} | (keep or {})
    narrow = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(k) for k, c in kept.items()])

    def run(batches):
        fn = make()
        for part in slices(batches):
            columns = fn(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *map(pa.array, columns.values())], names=[*kept, *columns])

    return narrow.mapInArrow(run, ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in kept.items()) + f", {schema}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Rows of a task, where the number of rows is known and small tables need not keep the files of large ones.
TASK_ROWS = 100_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and kept when executors are lost. ``rows``, if known, bounds the
    number of rows and so the tasks that write them."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // TASK_ROWS)).write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


# Folders of the tables saved in each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are saved inside go at the end, but for those that ``keep`` was given right after they were saved: they belong to the scope around it, or to
    the caller. What reads a table that goes must have been written by then."""
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(_scopes[-1][-1])
        return table

    _scopes.append([])
    try:
        yield keep
    finally:
        made = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        for path in made:
            if path not in kept:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int, how: str = "inner",
                share: int = 2_000, salts: int = 64) -> DataFrame:
    """Join many ``rows`` with one row per key of ``groups``, where ``size`` counts the key's rows.

    A key with more than ``total / share`` rows is hot; at most ``share`` keys can be, so their list is broadcast. Rows of a
    hot key are spread over ``salts`` slices by the hash of ``spread`` and the group's row is repeated per slice. Null keys match nothing.
    """
    floor = max(total / share, 1)
    hot = groups.where(F.col(size) > floor).select(key).withColumn("_hot", F.lit(True))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col(size) > floor, F.lit(salts)).otherwise(1)
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows in the order of ``by`` and ``order``, per group ``by``; groups of any size.

    Rows are range-partitioned on all of these columns, so a large group spans tasks; each partition's totals per group
    (one row per partition and group in it) give the later ones their start.
    """
    by = by or []
    spark = df.sparkSession
    cols = [*by, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id())
    placed = saved(ranged, "ranged")
    totals = placed.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                           F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    on = placed["_part"] == starts["_part"]
    for i, c in enumerate(by):
        on &= placed[c].eqNullSafe(starts[f"_by{i}"])
    summed = placed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = summed["_part"] == starts["_part"]
    for i, c in enumerate(by):
        on &= summed[c].eqNullSafe(starts[f"_by{i}"])
    return (summed.join(starts, on).withColumn(out, (F.col("_start") + F.col("_in")).cast("bigint"))
            .drop(starts["_part"], *[f"_by{i}" for i in range(len(by))]).drop("_part", "_start", "_in"))


# Bloom filters ----------------------------------------------------------------------------------------

# A key takes one 64-bit block and two bits in it; so many bits a key.
BITS_PER_KEY = 16


def bloom_place(key: Column, keys: int) -> tuple[Column, Column, Column]:
    """Block number and two different bit positions of a 64-bit ``key`` hash, for a filter of ``keys`` keys."""
    blocks = max(1, keys * BITS_PER_KEY // 64)
    mixed = F.xxhash64(key)
    first = F.shiftrightunsigned(mixed, 58).cast("int")
    step = (F.pmod(F.shiftrightunsigned(mixed, 48), F.lit(63)) + 1).cast("int")
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)), first, F.pmod(first + step, F.lit(64)).cast("int")


def bloom_mask(first: Column, second: Column) -> Column:
    """``shiftleft`` takes a literal number of bits in Python, so this goes through the SQL function."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), first).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), second))


def bloom_filter(df: DataFrame, key: Column, keys: int) -> DataFrame:
    """(block, bits): one row per 64-bit block that holds a key."""
    block, first, second = bloom_place(key, keys)
    return df.select(block.alias("_block"), bloom_mask(first, second).alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))


def bloom_hits(df: DataFrame, key: Column, filter_: DataFrame, keys: int, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a boolean: the filter may hold ``key``. Null keys never hit. The filter has at most keys/4 + 1 rows of 16 bytes
    (about 48 in the broadcast table); it is broadcast while that fits ``broadcast_bytes`` and joined on the block beyond."""
    block, first, second = bloom_place(key, keys)
    blocks = max(1, keys * BITS_PER_KEY // 64)
    side = F.broadcast(filter_) if blocks * 48 <= broadcast_bytes else filter_
    mask = F.col("_mask")
    return (df.withColumn("_block", F.when(key.isNotNull(), block)).withColumn("_mask", bloom_mask(first, second)).join(side, "_block", "left")
            .withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_block", "_mask", "_bits"))


# Graph components -------------------------------------------------------------------------------------

def lookup(rows: DataFrame, key: str, table: DataFrame, key_of: str, value: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of the one row of ``table`` whose ``key_of`` equals ``key`` (null where there is none); any key may be hot."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    groups = sizes.join(table.select(F.col(key_of).alias(key), F.col(value)), key)
    return salted_join(rows, groups, key, "_size", F.struct(*rows.columns), total, "left").drop("_size")


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to): every node of all edges of a task, and the smallest node that they join it to."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for part in slices(batches):
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["a", "to"])


def components(edges: DataFrame, few: int = TASK_ROWS) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): nodes share a root exactly when a path joins them.

    Each round sends a node to the neighbour (or itself) that comes first and shrinks the edges to the ends' new names; the rounds' maps
    are then followed. The first rounds go by number, which settles stars around their smallest node at once; later ones by a random
    order of their own, so that chains of any shape shrink by a constant factor. Rounds are written to the shared folder. A round takes the
    driver some twenty jobs and eight broadcasts, however little is left: so once at most ``few`` edges are left, a number that does not
    grow with the input, one task joins them and the rounds end.
    """
    names: DataFrame | None = None
    left = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    for turn in range(200):
        count = left.count()
        if not count:
            break
        if count <= few:
            step = saved(left.coalesce(1).mapInArrow(_joined, "a long, to long"), "step")
        else:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))

            def order(c: str, turn: int = turn) -> Column:
                first = F.xxhash64(F.col(c), F.lit(turn)) if turn > 2 else F.lit(0)
                return F.struct(first.alias("o"), F.col(c).alias("node"))

            step = saved(both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a"))).getField("node").alias("to"), F.count(F.lit(1)).alias("degree")), "step", 2 * count)
            # a node's degree bounds how often it stands at either end
            total = 2 * count
            moved = salted_join(left, step, "a", "degree", F.col("b"), total).select(F.col("to").alias("a"), "b")
            moved = salted_join(moved, step.withColumnRenamed("a", "b"), "b", "degree", F.col("a"), total).select("a", F.col("to").alias("b"))
            left = saved(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", count)
            step = step.drop("degree")
        if names is None:
            names, nodes = step.select(F.col("a").alias("node"), F.col("to").alias("root")), 2 * count
        else:
            found = lookup(names, "root", step.withColumnRenamed("a", "k"), "k", "to", nodes)
            names = saved(found.select("node", F.coalesce("to", "root").alias("root")), "names", nodes)
        if count <= few:
            break
    else:
        raise RuntimeError("components did not settle")
    return names if names is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
