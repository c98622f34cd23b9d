"""Approximate nearest neighbours by largest inner product: several shifted Hilbert orderings of projected vectors, whose windows are reranked."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.llm.common import running_total, salted_join, saved, slices

CURVES, DIMS, BITS = 8, 6, 4
# A window reaches this share of the indexed rows, and so many rows more, to each side of a query's place.
SHARE, REACH = 0.1, 200
# Rows of a tile of an ordering; a task holds one tile's vectors and CHUNK queries.
TILE, CHUNK = 4_096, 512
# Vectors that place the orderings' grid (those with the smallest hash of their id); every row is indexed.
FIT_ROWS = 4_096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (coordinates below 2**bits): axes are exchanged or flipped bit by bit from
    the top, then Gray-coded, then interleaved."""
    x = [c.astype(np.uint64) for c in cells.T]
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << shift), np.uint64((1 << shift) - 1)
        for i in range(dims):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << shift)) != 0, np.uint64((1 << shift) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for shift in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | (((axis ^ flip) >> np.uint64(shift)) & np.uint64(1))
    return key.astype(np.int64)


@dataclass
class Orderings:
    """One projection, centre, scale and shift per curve, for vectors extended so that nearness is inner product."""

    largest: float
    projections: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    bits: int

    @classmethod
    def fit(cls, sample: np.ndarray, width: int, largest: float, curves: int, dims: int, bits: int, seed: int = 11) -> Orderings:
        rng = np.random.default_rng(seed)
        dims = min(dims, width + 1)
        projections = np.stack([np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0][:, :dims] for _ in range(curves)])
        made = cls(largest, projections, np.zeros((curves, dims)), np.ones((curves, dims)), rng.uniform(0, 1, (curves, dims)), bits)
        if len(sample):
            placed = np.einsum("nw,cwd->cnd", made.extended(sample, False), projections)
            made.centre, made.scale = placed.mean(1), np.maximum(placed.std(1), 1e-12)
        return made

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With one coordinate more, all indexed vectors have the largest norm; a query is stretched to it. Then the nearest by
        distance is the one with the largest inner product."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack([x * (self.largest / norm), np.zeros_like(norm)])
        return np.hstack([x, np.sqrt(np.maximum(self.largest**2 - norm**2, 0))])

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(curve, row): places in each ordering."""
        x, side = self.extended(x, query), 1 << self.bits
        out = []
        for p, centre, scale, shift in zip(self.projections, self.centre, self.scale, self.shift):
            unit = ((x @ p - centre) / scale + 3) / 6
            cells = np.clip(unit * (side - 1) + shift, 0, side - 1e-9).astype(np.int64)
            out.append(hilbert_keys(cells, self.bits))
        return np.stack(out)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
            dims: int = DIMS, bits: int = BITS, share: float = SHARE, reach: int = REACH) -> DataFrame:
    """The ``k`` nearest found for each query row (``is_query`` over the columns of ``vectors``): query_id, rank from 1, vec_id, score.

    Candidates are all rows with another id; nearness is the inner product of the original vectors in double precision, nearest first,
    ties to the smaller id; with fewer candidates all are returned. Rows with a null id, a vector that is not ``usable``, or one of
    another length than the most frequent (of equally frequent ones the shortest) take no part. A row that repeats id and vector counts once. An empty table gives no rows; other
    columns are not read. Of equal vectors the k+1 smallest ids are placed in the orderings, since no answer can hold a later one,
    and equal queries are searched once.

    In each ordering rows are numbered by a range-partitioned sort and cut into tiles by number; a query goes to the tiles that its
    window meets. Each tile gives its best k+1 by exact score; these merge per query. ``share`` fixes recall: vectors without
    structure need windows in proportion to the table, clustered ones can do with ``share=0`` and a fixed ``reach``.
    """
    element = vectors.schema[vector].dataType.elementType.typeName()
    kind, cast = ("<f4", "float") if element == "float" else ("<f8", "double")
    base = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector).cast(f"array<{cast}>").alias("vector"))

    def pack(batches):
        for part in slices(batches, 4_096):
            rows = [np.array(v, kind) for v in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary()),
                                              pa.array([float(np.linalg.norm(r.astype(np.float64))) for r in rows], pa.float64())],
                                             ["vec_id", "is_query", "vec", "norm"])

    rows = saved(base.mapInArrow(pack, "vec_id long, is_query boolean, vec binary, norm double"), "vectors")
    facts = rows.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bytes").first()
    if facts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.octet_length("vec") == facts["bytes"])
    width = facts["bytes"] // np.dtype(kind).itemsize
    facts = rows.agg(F.max("norm").alias("largest"), F.count(F.lit(1)).alias("n")).first()

    copies = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    index = saved(rows.groupBy("vec_id", "vec").agg(F.max("is_query").alias("is_query")).withColumn("_copy", copies).where(F.col("_copy") <= k + 1).select("vec_id", "vec"), "index")
    asked = rows.where("is_query").select("vec_id", "vec").distinct()
    nodes = saved(asked.groupBy("vec").agg(F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()), "queries")
    n = index.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec").toArrow()["vec"].combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast(Orderings.fit(_matrix(sample, kind), width, facts["largest"], curves, dims, bits))

    def keyed(batches):
        orderings = shared.value
        for part in slices(batches, 2_048):
            query = np.array([v is None for v in part.column("vec_id").to_pylist()])
            x = _matrix(part.column("vec"), kind)
            keys = np.empty((curves, len(x)), np.int64)
            for flag in (False, True):
                if (query == flag).any():
                    keys[:, query == flag] = orderings.keys(x[query == flag], flag)
            for curve in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), curve, np.int32)), pa.array(keys[curve]), part.column("vec_id"), part.column("node"),
                                                  part.column("vec"), pa.array((~query).astype(np.int64))], ["curve", "key", "vec_id", "node", "vec", "one"])

    none = F.lit(None).cast("bigint")
    both = index.withColumn("node", none).unionByName(nodes.select(none.alias("vec_id"), "vec", "node"))
    ordered = running_total(both.mapInArrow(keyed, "curve int, key long, vec_id long, node long, vec binary, one long"), ["key", "one", "vec_id"], "one", "at", ["curve"])
    window = int(np.ceil(share * n)) + reach
    place = F.floor(F.col("at") / TILE)
    first, last = F.floor(F.greatest(F.col("at") - window, F.lit(0)) / TILE), F.floor(F.least(F.col("at") + window, F.lit(max(n - 1, 0))) / TILE)
    tiled = ordered.withColumn("tile", F.explode(F.when(F.col("one") == 1, F.array(place)).otherwise(F.sequence(F.least(first, last), last))))
    dealt = tiled.select("curve", "tile", "one", "vec_id", "node", "vec").repartition("curve", "tile").sortWithinPartitions("curve", "tile", F.desc("one"))

    def search(batches):
        def chunks():
            for part in slices(batches, CHUNK):
                ends = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()))
                start = 0
                for key, run in groupby(ends):
                    count = len(list(run))
                    yield key, part.slice(start, count)
                    start += count

        for _, parts in groupby(chunks(), key=lambda c: c[0][:2]):
            ids, held, x = [], [], None
            for (_, _, one), part in parts:
                if one:
                    ids.append(part.column(3).to_numpy(zero_copy_only=False))
                    held.append(_matrix(part.column(5), kind))
                    continue
                if not held:
                    continue
                if x is None:
                    x, names = np.concatenate(held), np.concatenate(ids)
                yield best(_matrix(part.column(5), kind), part.column(4).to_pylist(), x, names)

    def best(q: np.ndarray, asked: list[int], x: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        rough = q @ x.T
        take = min(k + 1, len(x))
        # Products of two blocks may differ in the last bits from place to place: keep all that could be among the best, then score them alike.
        low = np.partition(rough, len(x) - take, axis=1)[:, len(x) - take]
        slack = 1e-12 * (np.abs(q).sum(1) + 1) * (np.abs(x).max() + 1)
        out = [[], [], []]
        for i, node in enumerate(asked):
            near = np.flatnonzero(rough[i] >= low[i] - slack[i])
            score = (q[i] * x[near]).sum(axis=1)
            order = np.lexsort((names[near], -score))[:take]
            out[0].append(np.full(len(order), node))
            out[1].append(names[near][order])
            out[2].append(score[order])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "vec_id", "score"])

    found = dealt.mapInArrow(search, "node long, vec_id long, score double")
    merged = found.groupBy("node", "vec_id").agg(F.max("score").alias("score"))
    top = merged.withColumn("_at", F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "vec_id"))).where(F.col("_at") <= k + 1)
    lists = top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("_at", "vec_id", "score"))).alias("near"))
    groups = nodes.join(lists, "node").select("vec", "copies", "near")
    answers = salted_join(asked, groups, "vec", "copies", F.col("vec_id"), facts["n"]).select(F.col("vec_id").alias("query_id"), "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("_pos", "_hit")).select(
        "query_id", (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))
