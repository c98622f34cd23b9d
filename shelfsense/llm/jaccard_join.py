"""Exact n-gram Jaccard components: size-banded tiles, bitmap signatures that bound the overlap, then sorted-array intersection."""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import (BROADCAST_BYTES, REMEMBERED_BYTES, bloom_filter, bloom_hits, components, lookup, map_texts, running_total, salted_join, saved, scratch,
                                   slices)

# Size bands grow by this factor.
BAND = 1.5
# A tile holds members up to this weight; a member weighs its shingles plus MEMBER.
TILE = 1_000_000
# Bitmaps are small and their comparisons plain, so their tiles hold so many times more, and fewer pairs of tiles carry copies of them.
BITMAP_TILES = 4
MEMBER = 2_000
# Bits of a signature within a tile of sets, and of one that travels in place of its set.
SIGNATURE, TRAVELLING = 1_024, 4_096
# Words of a worker's cache, some 20 MB; common words are few, and a worker keeps the memory of its fullest cache.
REMEMBERED = 100_000
# Part keys that a task gathers before they are packed, keys of a part (about), bytes of a key in its part, and rows of pairs in one batch.
CHUNK_KEYS, PART_KEYS, KEY_BYTES, PAIRS = 500_000, 1 << 20, 5, 100_000
# Consecutive row numbers whose keys are counted together, so that a frequent key is told once to all of them.
CHUNK_ROWS = 512


class Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


def shingle_set(text: bytes, n: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z lower-cased; fewer words are one shingle, none is no shingle."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if len(codes) < n:
        return np.array([xxhash.xxh3_64_intdigest(codes.tobytes(), seed=1)], np.uint64)
    count = len(codes) - n + 1
    mixed = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            mixed = (mixed ^ codes[i:i + count]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache(maxsize=None)
def band_plan(band: int, similarity: float) -> tuple[int, int, int, int]:
    """(low, high, differ, slack) of a size band low <= size < high.

    Two similar sets that meet in the band differ in at most ``differ`` shingles. With differ + slack + 1 parts of the hash range, more than
    ``slack`` parts hold the same shingles in both. If each set leaves out the ``slack`` parts that come first in one order of all contents,
    the last of the parts that both have is left out by neither.
    """
    low = 1
    for _ in range(band):
        low = int(low * BAND) + 1
    high = int(low * BAND) + 1
    differ = int((1 - similarity) / (1 + similarity) * 2 * (high - 1) + 1e-9)
    return low, high, differ, 2 + differ // 4


def bands(size: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(band, parts, slack, differ) of a set: its own band, and the next one if a set of that band can be similar to it. A band in which
    similar sets are equal needs no parts."""
    found, band = [], 0
    while True:
        low, high, differ, slack = band_plan(band, similarity)
        if similarity * low > size + 1e-9:
            return found
        if size < high and differ:
            found.append((band, differ + slack + 1, slack, differ))
        band += 1


def part_keys(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """A key for each of the set's ``bands`` and each part of the hash range, in this order: the sum of the part's shingles, stirred."""
    keys = []
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles, dtype=np.uint64)])
        for band, parts, _, _ in bands(len(shingles), similarity):
            of = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            edges = np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))
            key = running[edges[1:]] - running[edges[:-1]] + np.arange(parts, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            key ^= np.uint64(band + 1) * np.uint64(0xA0761D6478BD642F)
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB)
            keys.append(key ^ (key >> np.uint64(28)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


# Tiles ------------------------------------------------------------------------------------------------

def signatures(sets: list[np.ndarray], bits: int = SIGNATURE) -> np.ndarray:
    """A bitmap per set: the bits that its shingles hash to."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        bit = s & np.uint64(bits - 1)
        np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def tile_links(sizes: list[int], sets: list[np.ndarray], group: list[int], num: int, den: int, exact: bool = True) -> list[tuple[int, int]]:
    """Links (i, j) that join members of different ``group`` into everything that the tile's links join.

    Members come in order of size. ``sets`` are their sorted shingles, or what differs between them and one reference: the difference of
    two members is the same either way. For each member, the others it may link by size and by bitmap (a bit that only one of two has
    stands for a shingle that only one has, which bounds the overlap from above) are compared exactly unless already joined. Unless
    ``exact``, ``sets`` are bitmaps and what the bound allows is a link.
    """
    parent = {g: g for g in group}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    size = np.array(sizes)
    length = np.array([len(s) for s in sets])
    bitmap, links = signatures(sets) if exact else np.stack(sets), []
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(size, size[i] * den // num, side="right"))
        if last <= i + 1:
            continue
        both = size[i] + size[i + 1:last]
        most = both + 2 * (both * -num // (num + den))  # differences that a link allows
        least = np.bitwise_count(bitmap[i] ^ bitmap[i + 1:last]).sum(1, dtype=np.int64)
        for j in (np.flatnonzero(least <= most) + i + 1).tolist():
            a, b = root(group[i]), root(group[j])
            if a == b:
                continue
            if not exact:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
                continue
            short, long = (sets[i], sets[j]) if length[i] <= length[j] else (sets[j], sets[i])
            same = 0
            if len(short):
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                same = int((long[at] == short).sum())
            differ = length[i] + length[j] - 2 * same
            total = size[i] + size[j]
            if den * (total - differ) >= num * (total + differ):
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _tiles(rows: DataFrame, num: int, den: int, exact: bool = True) -> DataFrame:
    """Links (a, b) of all tiles of ``rows``: tile, node, grp, size, set. A tile is bounded, so it may stand in one task."""

    def run(batches):
        for _, members in groupby(_rows_of(batches, 64), key=lambda r: r[0]):
            members = {node: (group, size, np.frombuffer(s, np.uint64)) for _, node, group, size, s in members}
            order = sorted(members, key=lambda node: (members[node][1], node))
            groups, sizes, sets = zip(*(members[n] for n in order))
            links = tile_links(sizes, sets, groups, num, den, exact)
            yield pa.RecordBatch.from_arrays([pa.array([order[i] for i, _ in links], pa.int64()), pa.array([order[j] for _, j in links], pa.int64())], ["a", "b"])

    dealt = rows.select("tile", "node", "grp", "size", "set").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text",
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two rows link when den * |intersection| >= num * |union| of their sets of n-word shingles; ``component_id`` is the smallest doc_id
    that links reach, itself included. A null or empty text, or one without words, has no shingles and links with nothing. Null doc_ids
    are passed over for the smallest (null where all are null); repeated rows repeat and are linked; an empty table gives no rows; other
    columns are not read. Shingles are compared by 64-bit, whole sets by 128-bit hash.

    Equal sets collapse to one node. Nodes that share the content of a part of the hash range in one size band (``bands``: no link can miss
    this) are candidates, but for each set's most frequent parts (``_rare_keys``), so passages of many documents join nothing. Keys travel
    packed, about six bytes each (``_shared_keys``). A component of candidates is a
    tile; a large one is cut into tiles in order of size, which are first compared by bitmaps alone. Each tile is settled in itself and
    against the first members of tiles at distances 1, 2, 4 and so on; what is then still apart from its component's largest part meets
    every tile that its sizes allow.
    """
    similarity = num / den
    with scratch(docs.sparkSession) as keep:
        hashed = _scan(docs, doc_id, text, n, similarity)
        # The keys, most of what is written, go once they have met.
        scanned = keep(saved(hashed.drop("keys"), "rows"))
        total, shingles = scanned.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
        sets = scanned.where("n_shingles > 0").groupBy("set_hash").agg(
            F.min("doc_id").alias("least"), F.min("row").alias("node"), F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies"))
        sets = keep(saved(sets, "sets"))
        distinct = sets.count()

        # Part keys of one row per set; a false positive of the filter lets a copy's keys in, which changes nothing.
        keyed = bloom_hits(hashed.where("n_shingles > 0 AND size(keys) > 0").select("row", "n_shingles", "keys"), F.col("row"),
                           bloom_filter(sets, F.col("node"), distinct), distinct, "one", broadcast_bytes).where("one")
        # Written in between: two Python functions in one stage are two workers to a task, which keep their memory.
        rare = saved(_rare_keys(keyed.select("row", "n_shingles", "keys"), shingles or 0, similarity), "rare")
        stars = keep(saved(_shared_keys(rare, shingles or 0).distinct(), "stars"))
    candidates = components(stars)

    links = saved(_verified(docs, doc_id, text, n, sets, candidates, num, den, broadcast_bytes), "links")
    roots = components(links)
    placed = saved(sets.join(roots, "node", "left"), "placed")  # a node is one row on either side
    joined = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(lookup(placed, "root", joined, "root", "component_id", distinct).select(
        "set_hash", "copies", F.coalesce("component_id", "least").alias("component_id")), "named")
    narrow = scanned.select("doc_id", "n_shingles", "set_hash", "row")
    return salted_join(narrow, named, "set_hash", "copies", F.col("row"), total, "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _scan(docs: DataFrame, doc_id: str, text: str, n: int, similarity: float) -> DataFrame:
    """doc_id, n_shingles, set_hash (null without shingles), keys, row; written once."""

    def make():
        words = Words()

        def columns(texts: list[bytes]) -> dict:
            found = [shingle_set(t, n, words) for t in texts]
            return {"n_shingles": pa.array([len(s) for s in found], pa.int64()),
                    "set_hash": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                    "keys": pa.array([part_keys(s, similarity).view(np.int64) for s in found], pa.list_(pa.int64()))}

        return columns

    found = map_texts(docs, doc_id, text, "n_shingles long, set_hash binary, keys array<long>", make)
    return saved(found.withColumn("row", F.monotonically_increasing_id()), "shingles")


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, all first bytes first: of sorted or near numbers the shuffle's compression drops the high ones."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(planes) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return wide.view(np.uint64).ravel()


def _meet(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the smallest node of each, and distinct rows (node, smallest node) of every other node of a key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    leaders = nodes[first]
    pairs = np.stack([nodes[~first], leaders[np.cumsum(first) - 1][~first]], 1)
    return keys[first], leaders, np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _part_bits(most: int) -> int:
    """First bits of a key that name its part, for about ``most`` keys."""
    return min(18, max(6, (most // PART_KEYS).bit_length()))


def _rows_of(batches, size: int):
    for part in slices(batches, size):
        yield from zip(*(c.to_pylist() for c in part.columns))


def _binary_batches(rows: list[tuple], types: list[pa.DataType], names: list[str]):
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 256]), types)], names)


def _rare_keys(keyed: DataFrame, most: int, similarity: float) -> DataFrame:
    """(row, keys): of the part keys of each set (row, n_shingles and keys, all that ``part_keys`` gives) those that it shows and others have too.

    In each band a set leaves out its ``slack`` most frequent keys, ties to the smaller key: the order is one for all sets, so similar sets
    still share a key (``band_plan``), and a passage of many documents, which fills few parts of each, joins nothing. Rows are taken in chunks by
    number. Chunks send distinct keys with counts to the keys' parts, which send totals of keys seen twice or more back to the chunks;
    there they meet the keys of the chunk's rows. A key in a third of all rows is so one entry per chunk.
    """
    bits = _part_bits(most)
    cut, wide, low = np.uint64(64 - bits - KEY_BYTES * 8), -(-(bits + KEY_BYTES * 8) // 8), np.uint64((1 << KEY_BYTES * 8) - 1)
    part_of = np.uint64(KEY_BYTES * 8)

    def chunks(batches):
        """(chunk, rows, sizes, keys) of rows that come one after the other and have their chunk in common."""
        rows, sizes, keys, held = [], [], [], 0
        for part in slices(batches, 64):
            lists = part.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> cut
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for row, size, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), np.split(values, ends[:-1])):
                if rows and (row // CHUNK_ROWS != rows[0] // CHUNK_ROWS or held >= CHUNK_KEYS):
                    yield rows[0] // CHUNK_ROWS, rows, sizes, np.concatenate(keys)
                    rows, sizes, keys, held = [], [], [], 0
                rows.append(row)
                sizes.append(size)
                keys.append(own)
                held += len(own)
        if rows:
            yield rows[0] // CHUNK_ROWS, rows, sizes, np.concatenate(keys)

    def count(batches):
        for chunk, _, _, keys in chunks(batches):
            key, times = np.unique(keys, return_counts=True)
            parts = key >> part_of
            at = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            rows = [(int(parts[i]), chunk, _planes(key[i:j] & low, KEY_BYTES), _planes(times[i:j], 4)) for i, j in zip(at, [*at[1:], len(key)])]
            yield from _binary_batches(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["part", "chunk", "key", "times"])

    def total(batches):
        for part, rows in groupby(_rows_of(batches, 64), key=lambda r: r[0]):
            rows = [(chunk, _numbers(key, KEY_BYTES), _numbers(times, 4)) for _, chunk, key, times in rows]
            _, which = np.unique(np.concatenate([key for _, key, _ in rows]), return_inverse=True)
            all_ = np.bincount(which, np.concatenate([times for _, _, times in rows]).astype(float))[which].clip(max=2**32 - 1).astype(np.uint64)
            told, start = [], 0
            for chunk, key, _ in rows:
                mine = all_[start:start + len(key)]
                start += len(key)
                some = mine > 1
                if some.any():
                    told.append((chunk, True, _planes(key[some] | np.uint64(part << KEY_BYTES * 8), wide), _planes(mine[some], 4), b""))
            yield from _binary_batches(told, types, names)

    def bring(batches):
        for chunk, rows, sizes, keys in chunks(batches):
            row = (chunk, False, _planes(keys, wide), _planes(np.array(rows, np.int64), 8), _planes(np.array(sizes, np.int64), 8))
            yield from _binary_batches([row], types, names)

    def choose(batches):
        for _, rows in groupby(_rows_of(batches, 64), key=lambda r: r[0]):
            known, times, sets = [np.zeros(1, np.uint64)], [np.ones(1, np.uint64)], []
            for _, told, key, first, second in rows:
                if told:
                    known.append(_numbers(key, wide))
                    times.append(_numbers(first, 4))
                else:
                    sets.append((_numbers(key, wide), _numbers(first, 8).view(np.int64), _numbers(second, 8).tolist()))
            known, at = np.unique(np.concatenate(known), return_index=True)
            times = np.concatenate(times)[at].astype(np.int64)
            for key, nodes, sizes in sets:
                plans = [[(parts, slack) for _, parts, slack, _ in bands(size, similarity)] for size in sizes]
                owner = np.repeat(nodes, [len(p) for p in plans])
                parts, slack = np.array([x for p in plans for x in p], np.int64).reshape(-1, 2).T
                place = np.searchsorted(known, key)
                place[place == len(known)] = 0
                often = np.where(known[place] == key, times[place], 1)
                band = np.repeat(np.arange(len(parts)), parts)
                order = np.lexsort((key, -often, band))
                rank = np.arange(len(key)) - np.repeat(np.cumsum(parts) - parts, parts)
                shown = (rank >= np.repeat(slack, parts)) & (often[order] > 1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(band[shown], minlength=len(parts)))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key[order][shown] << cut).view(np.int64)))
                some = pa.array(np.diff(ends) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(owner).filter(some), lists.filter(some)], ["row", "keys"])

    types, names = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()], ["chunk", "told", "key", "first", "second"]
    schema = "chunk long, told boolean, key binary, first binary, second binary"
    counts = keyed.mapInArrow(count, "part int, chunk long, key binary, times binary").repartition("part").sortWithinPartitions("part")
    both = counts.mapInArrow(total, schema).unionByName(keyed.mapInArrow(bring, schema)).repartition("chunk").sortWithinPartitions("chunk")
    return both.mapInArrow(choose, "row long, keys array<long>")


def _shared_keys(keyed: DataFrame, most: int) -> DataFrame:
    """(a, b): each node that shares a key with others, and the smallest of those that it met. All nodes of a key are joined by these rows.

    ``keyed`` (row, keys) has about ``most`` keys or fewer. A task gathers keys in chunks; what meets in a chunk is settled there, so the most
    frequent key leaves it once. Keys are dealt to parts by their first bits and travel as sorted arrays of their next 40 bits, so parts hold
    some PART_KEYS keys each and different keys are taken for one only by 46 bits or more, which proposes a candidate too many.
    """
    bits = _part_bits(most)
    low, part_of = np.uint64((1 << KEY_BYTES * 8) - 1), np.uint64(64 - bits)
    cut = np.uint64(64 - bits - KEY_BYTES * 8)
    names = ["part", "met", "key", "node"]

    def packed(keys: list[np.ndarray], nodes: list[np.ndarray], turn: int):
        key, node, pairs = _meet(np.concatenate(keys), np.concatenate(nodes))
        at = np.flatnonzero(np.concatenate([[True], key[1:] >> part_of != key[:-1] >> part_of]))
        rows = [(int(key[i] >> part_of), False, _planes(key[i:j] >> cut & low, KEY_BYTES), _planes(node[i:j], 8)) for i, j in zip(at, [*at[1:], len(key)])]
        for i in range(0, len(pairs), PAIRS):
            rows.append(((turn + i // PAIRS) % (1 << bits), True, _planes(np.ascontiguousarray(pairs[i:i + PAIRS, 0]), 8), _planes(np.ascontiguousarray(pairs[i:i + PAIRS, 1]), 8)))
        yield from _binary_batches(rows, [pa.int32(), pa.bool_(), pa.binary(), pa.binary()], names)

    def chunks(batches):
        keys, nodes, held, turn = [], [], 0, 0
        for part in slices(batches, 64):
            rows = np.array(part.column(0).to_pylist(), np.int64).view(np.uint64)
            lists = part.column(1)
            keys.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            nodes.append(np.repeat(rows, lists.value_lengths().to_numpy(zero_copy_only=False)))
            turn += len(rows)
            held += len(keys[-1])
            if held >= CHUNK_KEYS:
                yield from packed(keys, nodes, turn)
                keys, nodes, held = [], [], 0
        if held:
            yield from packed(keys, nodes, turn)

    def meet(batches):
        for _, rows in groupby(_rows_of(batches, 16), key=lambda r: r[0]):
            keys, nodes, pairs = [], [], [np.empty((0, 2), np.uint64)]
            for _, met, key, node in rows:
                if met:
                    pairs.append(np.stack([_numbers(key, 8), _numbers(node, 8)], 1))
                else:
                    keys.append(_numbers(key, KEY_BYTES))
                    nodes.append(_numbers(node, 8))
            if keys:
                pairs.append(_meet(np.concatenate(keys), np.concatenate(nodes))[2])
            found = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
            for i in range(0, len(found), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(found[i:i + PAIRS, 0]), pa.array(found[i:i + PAIRS, 1])], ["a", "b"])

    dealt = keyed.mapInArrow(chunks, "part int, met boolean, key binary, node binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "a long, b long")


def _sets_of(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame, broadcast_bytes: int, bits: int = 0) -> DataFrame:
    """``wanted`` (set_hash, least and more) with ``set``, read again from a document that has it, or with a bitmap of so many ``bits`` in place
    of the set. A row that repeats id and text repeats its set, which tiles ignore."""
    known = wanted.count()
    ids = bloom_filter(wanted.where("least IS NOT NULL"), F.col("least"), known)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    some = bloom_hits(narrow, F.col("doc_id"), ids, known, "maybe", broadcast_bytes).where("maybe OR doc_id IS NULL")

    def make():
        words = Words()

        def columns(texts: list[bytes]) -> dict:
            found = [shingle_set(t, n, words) for t in texts]
            return {"set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "set": [s.tobytes() for s in (signatures(found, bits) if bits else found)]}

        return columns

    read = map_texts(some, "doc_id", "text", "set_hash binary, set binary", make)
    side = F.broadcast(wanted) if known * 160 <= broadcast_bytes else wanted
    return read.join(side, "set_hash").where("doc_id <=> least").drop("doc_id", "least", "set_hash")


def _differences(sets: DataFrame, references: DataFrame, members: int, broadcast_bytes: int) -> DataFrame:
    """``sets`` (root, node, size, set) with each set replaced by what differs between it and its root's reference."""
    held = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    if held <= broadcast_bytes:
        met = sets.repartition("node").join(F.broadcast(references.drop("members")), "root")  # not in the stage, and with the workers, that make the sets
    else:
        met = salted_join(sets, references, "root", "members", F.col("node"), members)

    def run(batches):
        for part in slices(batches, 64):
            pairs = zip(part.column(3).to_pylist(), part.column(4).to_pylist())
            differ = [np.setxor1d(np.frombuffer(s, np.uint64), np.frombuffer(r, np.uint64), assume_unique=True).tobytes() for s, r in pairs]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(differ, pa.binary())], ["root", "node", "size", "set"])

    return met.select("root", "node", "size", "set", "reference").mapInArrow(run, "root long, node long, size long, set binary")


def _placed(members: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """``members`` (set_hash, least, root, node, size) of components that are one tile, and of those that are several (None if there are none).
    The latter weigh more than a tile each, so there are at most total weight / TILE of them."""
    placed = saved(running_total(members.withColumn("weight", F.col("size") + MEMBER), ["size", "node"], "weight", "before", ["root"])
                   .withColumn("block", F.floor(F.col("before") / TILE)).drop("weight", "before"), "placed")
    several = saved(placed.where("block > 0").select("root", F.lit(True).alias("_many")).distinct(), "several")
    count = several.count()
    marked = placed.drop("block").join(F.broadcast(several) if count * 64 <= broadcast_bytes else several, "root", "left")
    return marked.where("_many IS NULL").drop("_many"), saved(marked.where("_many").drop("_many"), "many") if count else None


def _tiled(rows: DataFrame, times: int = 1) -> DataFrame:
    """``rows`` (root, node, size, set) with the ``block`` of their component that they stand in; a block weighs ``times`` tiles."""
    weighed = rows.withColumn("weight", (F.octet_length("set") / 8).cast("bigint") + MEMBER // 4)
    return saved(running_total(weighed, ["size", "node"], "weight", "before", ["root"]).withColumn("block", F.floor(F.col("before") / (times * TILE))).drop("weight", "before"), "tiled")


def _verified(docs: DataFrame, doc_id: str, text: str, n: int, sets: DataFrame, candidates: DataFrame, num: int, den: int, broadcast_bytes: int) -> DataFrame:
    """Links (a, b) between candidate nodes that join exactly what all links join."""

    def read(wanted: DataFrame, bits: int = 0) -> DataFrame:
        return _sets_of(docs, doc_id, text, n, wanted, broadcast_bytes, bits)

    def settled(one: DataFrame) -> DataFrame:
        found = read(one)
        return _tiles(found.select(F.struct("root").alias("tile"), "node", F.col("node").alias("grp"), "size", "set"), num, den)

    columns = ["set_hash", "least", "root", "node", "size"]
    one, many = _placed(sets.join(candidates, "node").select(columns), broadcast_bytes)
    links = settled(one)
    if many is None:
        return links

    # Large components: first bitmaps alone meet, and only what their bound allows stays together.
    short = read(many, TRAVELLING).select("root", "node", "size", "set").dropDuplicates(["node"])
    allowed = components(_between_tiles(_tiled(short, BITMAP_TILES), num, den, broadcast_bytes, exact=False))
    one, many = _placed(many.drop("root").join(allowed, "node").select(columns), broadcast_bytes)
    links = links.unionByName(settled(one))
    if many is None:
        return links

    # Families of near copies: their tiles hold differences from the family's first set.
    heads = many.groupBy("root").agg(F.min(F.struct("size", "node")).getField("node").alias("node"), F.count(F.lit(1)).alias("members"))
    references = read(many.join(heads.drop("root"), "node")).dropDuplicates(["root"]).select("root", F.col("set").alias("reference"), "members")
    apart = _differences(read(many), saved(references, "references"), many.count(), broadcast_bytes).dropDuplicates(["node"])
    return links.unionByName(_between_tiles(_tiled(apart), num, den, broadcast_bytes))


def _between_tiles(placed: DataFrame, num: int, den: int, broadcast_bytes: int, exact: bool = True) -> DataFrame:
    """Links of components that fill several tiles: ``placed`` has root, block, node, size, set."""
    tiles = placed.groupBy("root", "block").agg(F.min(F.struct("size", "node")).getField("node").alias("head"), F.min("size").alias("low"), F.max("size").alias("high"))
    reach = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda p: F.col("_block") + F.call_function("shiftleft", F.lit(1).cast("bigint"), p))
    heads = placed.join(tiles.select(F.col("head").alias("node")), "node").withColumn("_block", F.col("block"))
    ahead = heads.withColumn("block", F.explode(reach)).join(tiles.select("root", "block"), ["root", "block"])
    columns = ["node", F.col("node").alias("grp"), "size", "set"]
    tile = F.struct("root", "block").alias("tile")
    first = saved(_tiles(placed.select(tile, *columns).unionByName(ahead.select(tile, *columns)), num, den, exact), "links")

    # What is not in its component's largest part by now meets every tile that its sizes allow.
    parts = components(first).withColumnRenamed("root", "part")
    open_ = saved(placed.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "open")
    largest = open_.groupBy("root", "part").count().groupBy("root").agg(F.max(F.struct("count", "part")).getField("part").alias("largest"))
    # At most total weight / TILE rows.
    largest, narrow = saved(largest, "largest"), open_.select("root", "block", "node", "size", "part")
    held = largest.count() * 64
    rest = narrow.join(F.broadcast(largest), "root") if held <= broadcast_bytes else lookup(narrow, "root", largest, "root", "largest", open_.count())
    rest = saved(rest.where("part <> largest").select("root", F.col("block").alias("other"), "node", "size"), "rest")
    if rest.isEmpty():
        return first
    blocks = rest.groupBy("root", "other").agg(F.min("size").alias("rest_low"), F.max("size").alias("rest_high"))
    near = (F.col("low") * num <= F.col("rest_high") * den) & (F.col("rest_low") * num <= F.col("high") * den)
    pairs = saved(blocks.join(tiles.select("root", "block", "low", "high"), "root").where(near).select("root", "block", "other"), "pairs")
    columns, tile = ["node", F.col("part").alias("grp"), "size", "set"], F.struct("root", "block", "other").alias("tile")
    left = open_.join(pairs, ["root", "block"]).select(tile, *columns)
    right = open_.drop("block").join(rest.select("node", "other"), "node").join(pairs, ["root", "other"]).select(tile, *columns)
    return first.unionByName(_tiles(left.unionByName(right), num, den, exact))


def keep_one_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs``, all columns, with one row of each component: the one with the smallest doc_id, nulls last; of rows that share it one stays.

    Rows without words stay. Rows are written once with a number of their own and go by that, so a row stays whose id a dropped row shares.
    Rows whose number the filter of dropped numbers does not hold pass straight through; the others meet these in a join. Columns may have
    any names.
    """
    packed = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    key = F.col("doc").getField(doc_id)
    keys = packed.select(F.struct(key.isNull().alias("none"), key.alias("id"), "row").alias("doc_id"), F.col("doc").getField(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        later = jaccard_components(keys, n, num, den, broadcast_bytes=broadcast_bytes).where("component_id <> doc_id")
        dropped = keep(saved(later.select(F.col("doc_id.row").alias("row")), "dropped"))
    known = dropped.count()
    marked = bloom_hits(packed, F.col("row"), bloom_filter(dropped, F.col("row"), known), known, "_maybe", broadcast_bytes)
    return marked.where("NOT _maybe").select("doc.*").unionByName(marked.where("_maybe").join(dropped, "row", "left_anti").select("doc.*"))
