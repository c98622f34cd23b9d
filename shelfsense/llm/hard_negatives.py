"""Hard negatives by an inverted multi-index: two half-space codebooks form cells, visited in the order of summed half-score bounds."""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.llm.common import BROADCAST_BYTES, saved, slices

# Vectors that the codebooks are fitted on; rows that a cell should hold; centroids of a half at most.
FIT_ROWS, CELL_ROWS, MOST_CENTROIDS = 4_096, 200, 256
# Rows of one part of the index (a task holds one at a time), and anchors that meet it in one task.
PART_ROWS, SLICE_ANCHORS = 8_192, 50_000
# Cells of the first round; each later round goes on to this times as many cells as all before.
FIRST_CELLS, GROWTH = 8, 8
CHUNK = 256


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each, 2, 4 or 8; the length of the vector tells which."""
    most = max(int(x.max()), -int(x.min())) if len(x) else 0
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpack(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(packed), dims), np.int64)
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, f"<i{len(b) // dims}") if dims else 0
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products; in doubles where every partial sum is exact."""
    size = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if size < 1 << 53 else a @ b.T


class Codebooks:
    """Centroids of the two halves of vectors of one length. Vectors of any other length have one cell, around zero."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.dims, self.cut = sample.shape[1], sample.shape[1] // 2
        self.halves = [self._fit(h, centroids) for h in (sample[:, :self.cut], sample[:, self.cut:])]

    @staticmethod
    def _fit(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
        centre = np.unique(x, axis=0)
        centre = centre[np.linspace(0, len(centre) - 1, min(k, len(centre))).astype(int)]
        for _ in range(rounds):
            near = np.argmin((centre ** 2).sum(1) - 2 * x @ centre.T, axis=1)
            for c in range(len(centre)):
                if (near == c).any():
                    centre[c] = x[near == c].mean(0)
        return centre

    def of(self, dims: int) -> list[np.ndarray]:
        return self.halves if dims == self.dims else [np.zeros((1, dims // 2)), np.zeros((1, dims - dims // 2))]

    def place(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the nearest centroid of every row and the distance to it."""
        out, cut = [], x.shape[1] // 2
        for half, centre in zip((x[:, :cut], x[:, cut:]), self.of(x.shape[1])):
            near = np.argmin((centre ** 2).sum(1) - 2 * half @ centre.T, axis=1)
            out.append((near, np.sqrt(((half - centre[near]) ** 2).sum(1))))
        return out


class Index:
    """What a search has to know: codebooks, radii of the centroids, and where the rows of each cell lie."""

    def __init__(self, books: Codebooks, radii: dict[int, tuple[dict, dict]], parts: dict[tuple[int, int, int], tuple[int, int]]):
        self.books, self.parts, self.halves = books, parts, {}
        for dims, sides in radii.items():
            self.halves[dims] = [(np.array(sorted(r)), book[sorted(r)], np.array([r[c] for c in sorted(r)])) for r, book in zip(sides, books.of(dims))]

    def visit(self, q: np.ndarray, start: int, end: int, floor: float, cap: float):
        """Cells (a, b) that a search of ``q`` reaches at the places ``start`` to ``end`` of its order, while a row in them can score ``floor`` or
        more; cells whose rows all score more than ``cap`` are passed over.

        Two lists of half-scores in falling order; a heap of pairs gives their sums in falling order, from (0, 0) on to each pair's neighbours.
        """
        bounds, names, lows, cut = [], [], [], len(q) // 2
        for half, (codes, centre, radius) in zip((q[:cut], q[cut:]), self.halves[len(q)]):
            mid, reach = centre @ half, np.sqrt((half ** 2).sum()) * radius
            slack = 1e-6 + 1e-9 * (np.abs(mid) + reach)
            order = np.argsort(-(mid + reach), kind="stable")
            bounds.append((mid + reach + slack)[order].tolist())
            lows.append((mid - reach - slack)[order].tolist())
            names.append(codes[order].tolist())
        heap, place = [(-(bounds[0][0] + bounds[1][0]), 0, 0)], 0
        while heap and place < end:
            bound, i, j = heapq.heappop(heap)
            if -bound < floor:
                return
            cell = (names[0][i], names[1][j])
            if (len(q), *cell) in self.parts:
                if place >= start and lows[0][i] + lows[1][j] <= cap:
                    yield cell
                place += 1
            if j + 1 < len(bounds[1]):
                heapq.heappush(heap, (-(bounds[0][i] + bounds[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(bounds[0]):
                heapq.heappush(heap, (-(bounds[0][i + 1] + bounds[1][0]), i + 1, 0))


def _coded(rows: DataFrame, books) -> DataFrame:
    """``rows`` with the cell (a, b) and the distances to its two centroids."""
    def run(batches):
        for part in slices(batches, 2_048):
            dims = np.array(part.column("dims").to_pylist())
            for d in np.unique(dims).tolist():
                own = part.take(pa.array(np.flatnonzero(dims == d)))
                (a, da), (b, db) = books.value.place(_unpack(own.column("vec").to_pylist(), d).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(da), pa.array(db)],
                                                 [*own.schema.names, "a", "b", "da", "db"])

    return rows.mapInArrow(run, "row long, vec_id long, label int, anchor boolean, dims int, vec binary, a int, b int, da double, db double")


def _layout(cells: list, part_rows: int) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Cell to its first part and the number of parts that its rows are dealt over: neighbouring small cells share a part, large ones span some."""
    out, part, filled = {}, 0, 0
    for dims, a, b, n in sorted(cells):
        pieces = -(-n // part_rows)
        if filled and (pieces > 1 or filled + n > part_rows):
            part, filled = part + 1, 0
        out[dims, a, b] = (part, pieces)
        part, filled = (part + pieces, 0) if pieces > 1 else (part, filled + n)
    return out


def _requests(state: DataFrame, index, start: int, end: int) -> DataFrame:
    """One row per anchor and part that it has to see in this round, with the cells (a * 2^16 + b) in it."""
    def run(batches):
        found = index.value
        for part in slices(batches):
            rows, parts, cells = [], [], []
            columns = [part.column(c).to_pylist() for c in ("dims", "vec", "floor", "cap")]
            for i, (dims, vec, floor, cap) in enumerate(zip(*columns)):
                by_part = defaultdict(list)
                for a, b in found.visit(_unpack([vec], dims)[0].astype(np.float64), start, end, floor, cap):
                    first, pieces = found.parts[dims, a, b]
                    for p in range(first, first + pieces):
                        by_part[p].append(a << 16 | b)
                for p, held in by_part.items():
                    rows.append(i)
                    parts.append(p)
                    cells.append(held)
            asked = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), asked.column("row"), asked.column("vec_id"), asked.column("label"), asked.column("dims"),
                                              asked.column("vec"), pa.array(cells, pa.list_(pa.int32())), asked.column("windows")],
                                             ["part", "row", "vec_id", "label", "dims", "vec", "cells", "windows"])

    return state.mapInArrow(run, "part int, row long, vec_id long, label int, dims int, vec binary, cells array<int>, windows array<struct<top:bigint,low:bigint>>")


def _meet(index: DataFrame, requests: DataFrame, anchors: int, k: int, same: bool) -> DataFrame:
    """(row, top, vec_id, score): from each part, the best ``k`` rows in the requested cells for each anchor and each of its windows: of the
    anchor's label (``same``, one window without bounds, top 0), or of another label with a score from low to top."""
    windows = "array<struct<top:bigint,low:bigint>>"
    slices_of = -(-max(anchors, 1) // SLICE_ANCHORS)
    held = index.select("part", F.explode(F.sequence(F.lit(0), F.lit(slices_of - 1))).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("row"),
                        "vec_id", "label", "dims", "vec", F.array((F.col("a") * 65_536 + F.col("b")).cast("int")).alias("cells"), F.lit(None).cast(windows).alias("windows"))
    asked = requests.select("part", F.pmod(F.xxhash64("row"), F.lit(slices_of)).cast("int").alias("slice"), F.lit(1).alias("kind"), "row", "vec_id", "label", "dims", "vec", "cells", "windows")
    wanted = asked.select("part").distinct()
    dealt = held.join(wanted, "part", "left_semi").unionByName(asked).repartition("part", "slice").sortWithinPartitions("part", "slice", "kind", "dims", "cells", "vec_id")

    def stretches(batches):
        for batch in slices(batches, CHUNK):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "kind"))))
            start = 0
            for key, run in groupby(keys):
                n = len(list(run))
                yield key, batch.slice(start, n)
                start += n

    def search(batches):
        for _, pieces in groupby(stretches(batches), key=lambda s: s[0][:2]):
            rows, matrices = [], None
            for (_, _, kind), piece in pieces:
                if not kind:
                    rows.append(piece)
                    continue
                if matrices is None:
                    matrices = cells_of(pa.Table.from_batches(rows)) if rows else {}
                yield answer(piece, matrices)

    def cells_of(table: pa.Table) -> dict:
        """(dims, cell) to ids, labels and vectors; the rows come in that order, ids ascending."""
        keys = list(zip(table.column("dims").to_pylist(), (c[0] for c in table.column("cells").to_pylist())))
        ids, labels, vec = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), table.column("vec").to_pylist()
        out, start = {}, 0
        for key, run in groupby(keys):
            n = len(list(run))
            out[key] = (ids[start:start + n], labels[start:start + n], _unpack(vec[start:start + n], key[0]))
            start += n
        return out

    def answer(piece: pa.RecordBatch, matrices: dict) -> pa.RecordBatch:
        wanted = defaultdict(list)
        dims, cells = piece.column("dims").to_pylist(), piece.column("cells").to_pylist()
        for i, (d, held) in enumerate(zip(dims, cells)):
            for c in held:
                wanted[d, c].append(i)
        q = [_unpack([v], d)[0] for v, d in zip(piece.column("vec").to_pylist(), dims)]
        own, label, windows = piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), piece.column("windows").to_pylist()
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        for key, who in wanted.items():
            if key not in matrices:
                continue
            ids, labels, x = matrices[key]
            who = np.array(who)
            score = products(np.stack([q[i] for i in who]), x)
            mine = labels[None, :] == label[who][:, None]
            fits = (mine if same else ~mine) & (ids[None, :] != own[who][:, None])
            # Rows that do not fit sort last; ids ascend, so a stable sort leaves ties to the smaller one.
            order = np.lexsort((-score, ~fits), axis=1) if score.shape[1] else np.zeros(score.shape, np.int64)
            sorted_scores, count = np.take_along_axis(score, order, 1), fits.sum(1)
            spans = range(1) if same else range(max((len(windows[i] or ()) for i in who), default=0))
            for w in spans:
                if same:
                    has, top, low, first = np.ones(len(who), bool), np.zeros(len(who), np.int64), None, np.zeros(len(who), np.int64)
                else:
                    has = np.array([w < len(windows[i] or ()) for i in who])
                    top, low = (np.array([windows[i][w][name] if h else 0 for i, h in zip(who, has)], np.int64) for name in ("top", "low"))
                    first = (fits & (score > top[:, None])).sum(1)
                for step in range(k):
                    at = first + step
                    good = np.flatnonzero(has & (at < count))
                    if low is not None:
                        good = good[sorted_scores[good, at[good]] >= low[good]]
                    out[0].append(who[good])
                    out[1].append(top[good])
                    out[2].append(ids[order[good, at[good]]])
                    out[3].append(sorted_scores[good, at[good]])
        i, top, ids, score = (np.concatenate(c) for c in out)
        order = np.lexsort((ids, -score, top, i))
        i, top, ids, score = i[order], top[order], ids[order], score[order]
        fresh = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(top, prepend=0) != 0))
        place = np.arange(len(i)) - np.repeat(fresh, np.diff([*fresh, len(i)])) if len(i) else np.empty(0, np.int64)
        keep = place < k
        rows = piece.column("row").to_numpy()[i[keep].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(top[keep], pa.int64()), pa.array(ids[keep], pa.int64()), pa.array(score[keep], pa.int64())],
                                          ["row", "top", "vec_id", "score"])

    return dealt.mapInArrow(search, "row long, top long, vec_id long, score long")


def _rounds(anchors: DataFrame, index: DataFrame, shared, n_anchors: int, n_cells: int, k: int, same: bool, report: list | None) -> DataFrame:
    """The best ``k`` rows of each window of each anchor. ``anchors`` has windows, ``low`` (what a row must score at least) and ``cap``.

    A round visits the next stretch of each anchor's cells, as far as their bounds reach what it still needs: the lowest, over its windows, of
    the kth best score found, or of the window's low end while fewer are found. An anchor below that is settled: no cell left can change it.
    """
    spark, best, start, end = index.sparkSession, None, 0, FIRST_CELLS
    place = F.row_number().over(W.partitionBy("row", "top").orderBy(F.desc("score"), "vec_id"))
    need = anchors.select("row", F.explode("windows").alias("w")).select("row", "w.top", "w.low").distinct()
    while start < n_cells:
        floors = need.groupBy("row").agg(F.min("low").alias("low"))
        if best is not None:
            full = best.groupBy("row", "top").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
            floors = need.join(full, ["row", "top"], "left").groupBy("row").agg(F.min(F.greatest("low", "kth")).alias("low"))
        state = anchors.join(floors, "row").select("row", "vec_id", "label", "dims", "vec", "windows", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("floor"), "cap")
        requests = saved(_requests(state, shared, start, end), "requests")
        asked = requests.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("cells")).first()
        if report is not None:
            report.append({"same_label": same, "cells": (start, end), "requests": asked["n"], "cells_asked": asked["cells"] or 0})
        if same and not asked["n"]:  # without a cap nothing is passed over: all anchors are settled
            break
        if asked["n"]:
            found = _meet(index, requests, n_anchors, k, same)
            merged = found if best is None else found.unionByName(best)
            best = saved(merged.withColumn("_place", place).where(F.col("_place") <= k).drop("_place"), "best")
        start, end = end, end * GROWTH
    return best if best is not None else spark.createDataFrame([], "row long, top long, vec_id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, part_rows: int = PART_ROWS, report: list | None = None) -> DataFrame:
    """For each anchor (``is_anchor``) and each of its first ``positives`` other rows of the same ``label``, the first ``negatives`` rows of
    another label whose score s meets low * p <= 100 * s <= high * p, p being the positive's: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. Exact.

    A component x counts as floor(``scale`` * x); a score is the whole-number inner product with the anchor, which must fit 64 bits. Higher scores
    come first, ties go to the smaller id. Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors
    of different lengths have no score, so they never meet. Rows that share an anchor's id are not among its positives or negatives; other
    repeated rows count each for itself, repeated anchors too. An anchor without a positive of score 0 or more has no rows; an empty table
    gives none. Columns that are not named are not read.

    Each half of a vector has a codebook (k-means on at most ``FIT_ROWS`` rows of the most frequent length, those of the smallest hash), and the two
    nearest centroids are the row's cell. The inner product with any row of a cell is at most the sum over both halves of centroid score
    plus half norm times the centroid's radius over all rows, so a heap over the two sorted lists visits cells by falling bounds and a search ends,
    certified, where the next bound is below what is needed. Positives are found first; they fix the windows, and cells above them are
    passed over. The search runs in rounds: each asks for the next cells of all unsettled anchors, and the rows of a part of the index meet
    the anchors that ask for it in one task, streamed in chunks. ``report`` gets a line per round.
    """
    element = vectors.schema[vector].dataType.elementType.typeName()
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("int").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                          F.col(vector).cast(f"array<{'float' if element == 'float' else 'double'}>").alias("vector"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))

    def pack(batches):
        for part in slices(batches, 2_048):
            whole = [np.floor(scale * np.array(v, np.float64)).astype(np.int64) for v in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in whole], pa.int32()), pa.array([_pack(x) for x in whole], pa.binary())],
                                             ["vec_id", "label", "anchor", "dims", "vec"])

    packed = base.mapInArrow(pack, "vec_id long, label int, anchor boolean, dims int, vec binary").withColumn("row", F.monotonically_increasing_id())
    rows = saved(packed.select("row", "vec_id", "label", "anchor", "dims", "vec"), "vectors")
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, n = lengths["dims"], lengths["count"]
    sample = rows.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(FIT_ROWS).select("vec").toArrow()["vec"].to_pylist()
    books = Codebooks(_unpack(sample, dims).astype(np.float64), min(MOST_CENTROIDS, int(np.ceil(np.sqrt(n / CELL_ROWS)))))
    coded = saved(_coded(rows, spark.sparkContext.broadcast(books)), "coded")

    cells = [tuple(r) for r in coded.groupBy("dims", "a", "b").count().collect()]
    radii: dict[int, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
    for side, (code, far) in enumerate((("a", "da"), ("b", "db"))):
        for r in coded.groupBy("dims", code).agg(F.max(far).alias("far")).collect():
            radii[r.dims][side][r[code]] = r.far
    parts = _layout(cells, part_rows)
    shared = spark.sparkContext.broadcast(Index(books, dict(radii), parts))
    where = spark.createDataFrame([(*c, *p) for c, p in parts.items()], "dims int, a int, b int, first int, pieces int")
    where = F.broadcast(where) if len(parts) * 64 <= BROADCAST_BYTES else where
    index = saved(coded.join(where, ["dims", "a", "b"]).withColumn("part", F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).select(
        "row", "vec_id", "label", "anchor", "dims", "vec", "a", "b", "part"), "index")

    window = "array<struct<top:bigint,low:bigint>>"
    asked = index.where("anchor").select("row", "vec_id", "label", "dims", "vec")
    n_anchors = asked.count()
    free = asked.withColumn("windows", F.array(F.struct(F.lit(0).cast("bigint").alias("top"), F.lit(None).cast("bigint").alias("low"))).cast(window)).withColumn("cap", F.lit(float("inf")))
    near = _rounds(free, index, shared, n_anchors, len(cells), positives, True, report).select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Whole numbers: the low end is p * low / 100 rounded up, the high end p * high / 100 rounded down; below 0 no score fits where low < high.
    top = F.floor(F.col("positive_score") * high / 100).cast("bigint") if high != 100 else F.col("positive_score")
    near = near.withColumn("top", top).withColumn("low", -F.expr(f"(-positive_score * {low} - pmod(-positive_score * {low}, 100L)) div 100"))
    open_ = near.where("low <= top")
    windows = open_.groupBy("row").agg(F.collect_set(F.struct("top", "low")).alias("windows"), F.max("top").cast("double").alias("cap"))
    far = _rounds(asked.join(windows, "row"), index, shared, n_anchors, len(cells), negatives, False, report)
    ranked = far.withColumn("rank", F.row_number().over(W.partitionBy("row", "top").orderBy(F.desc("score"), "vec_id")).cast("int"))
    out = open_.join(ranked.select("row", "top", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "top"])
    return out.join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
