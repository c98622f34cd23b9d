"""Every operator against brute force on one small table of hard cases, on an empty table, and on the given tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from conftest import SF
from shelfsense.llm import bpe, common, exact_dedup, factor_machine, hilbert_ann, jaccard_join, line_dedup, mixing, secret_scan, url_filter
from shelfsense.llm.queries import ORACLES, QUERIES, vocabulary_path

RNG = random.Random(3)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "ter", "ding", "a")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, LINE = prose(60), "this very line has far more than ten words in it today"
NEAR = BASE.replace(BASE.split()[30], "changed", 1)
# ids: repeated, null; texts: null, empty, blank, equal but for case, near copies, very long words and texts, special strings, repeated lines
ROWS = [
    (1, BASE, "en", "b"), (2, BASE.upper(), "en", "b"), (3, NEAR, None, "b"), (4, None, "en", None), (5, "", "de", "a"), (6, " \n\t ", "en", "a"),
    (7, f"{prose(5)}\n{LINE}\n{prose(12)}\n{LINE}", "en", "b"), (8, f"{LINE}\n{prose(9)}", "en", "c"), (9, "x" * 30000, "en", "c"),
    (10, prose(6000), "en", "b"), (11, "<|endoftext|> ÄÖ é😀 <|endoftext|>", "de", "Ä"), (None, "one two three four five six", "en", "b"),
    (None, "one two three four five six", "en", "b"), (12, BASE, "en", "b"), (12, BASE, "en", "b"), (13, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "en", "b"),
    (14, "short", "en", "a"), (15, "SHORT", "en", "a"), (16, "Éa éa", "fr", "b"), (17, "éa éa", "fr", "b"),
]
CLASHES = ("row", "sha", "key", "_maybe", "_block", "node", "size", "label", "doc", "id", "keep_id", "n_tokens", "score", "component_id", "rank")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * len(CLASHES)) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


def tuples(df):
    return Counter(map(tuple, df.collect()))


# Exact dedup ------------------------------------------------------------------------------------------

def test_exact_duplicates(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[(t or "").encode().lower()].append(i)
    want = Counter()
    for text, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text).hexdigest()
        kept = [False] * len(ids)
        kept[ids.index(top)] = True
        want.update((i, top, len(ids), k, sha) for i, k in zip(ids, kept))
    for size in (common.BROADCAST_BYTES, 0):  # the filter broadcast, and joined
        assert tuples(exact_dedup.exact_duplicates(docs, broadcast_bytes=size)) == want
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, *_, kept, _ in want.elements() if kept)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


# Tokens -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_encoding_is_the_librarys(docs, empty, library):
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in ROWS}
    want = Counter()
    for i, t, *_ in ROWS:
        raw, back = np.array(ids[t], "<u4").tobytes(), library.decode(ids[t], skip_special_tokens=False)
        want[(i, len(ids[t]), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert tuples(bpe.encoding_digests(bpe.encode_documents(docs, vocabulary_path()))) == want
    counted = Counter((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 512) for i, t, *_ in ROWS)
    assert tuples(bpe.token_counts(docs, vocabulary_path())) == counted
    assert bpe.token_counts(empty, vocabulary_path()).count() == 0 and bpe.encode_documents(empty, vocabulary_path()).count() == 0


def test_pieces_and_white_space(library):
    vocabulary = bpe.Vocabulary.load(vocabulary_path()).prove_whole()
    encode, count = bpe.encoder(vocabulary), bpe.counter(vocabulary)
    rng, letters = random.Random(5), "ab 's'\t\n\r\x0b\x1c\x85\xa0\u2003\u3000éß漢😀\u0301²Ⅷ<|endoftext|>!?.1"
    for text in ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * 5000, "  lead", "trail  ", "<|endoftext|><|endoftext|>"]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = encode(text)
        assert list(np.frombuffer(packed, "<u4")) == ids and count(text) == len(ids)
        assert bpe.decode(vocabulary, packed) == library.decode(ids, skip_special_tokens=False)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    seen = []
    cache = bpe.Remembered(lambda k: seen.append(k) or len(k))
    assert [cache[k] for k in "abcda"] == [1] * 5 and len(seen) == 4 and len(cache) <= 3


def test_caches_do_not_keep_long_words():
    long = "x" * (common.REMEMBERED_BYTES + 1)
    pieces = bpe.Remembered(len)
    assert pieces[long] == len(long) and pieces["short"] == 5 and list(pieces) == ["short"]
    for words in (jaccard_join.Words(), factor_machine.Words()):
        assert words[long.encode()] == words[long.encode()] != words[b"short"] and list(words) == [b"short"]


# Jaccard join -------------------------------------------------------------------------------------------

def brute_components(rows, n, num, den):
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((r[0], len(sets[i]), least[root(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_hard_cases(docs, empty):
    assert tuples(jaccard_join.jaccard_components(docs, 3, 90, 100)) == brute_components(ROWS, 3, 90, 100)
    kept = jaccard_join.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.keep_one_each(empty).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Rows that share an id with a dropped one stay; null ids and repeats of the smallest id go."""
    rows = [(5, NEAR), (5, "nothing like the other rows here"), (1, BASE), (1, BASE.upper()), (None, NEAR + " end"), (None, "alone without an id at all"), (None, None),
            (7, "two null ids follow this row now"), (None, "a text of null ids that comes twice"), (None, "a text of null ids that comes twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    left = Counter((r.doc_id, (r.text or "").lower()) for r in jaccard_join.keep_one_each(df).collect())
    assert left == Counter([rows[1], (1, BASE.lower()), rows[5], (None, ""), rows[7], rows[8]])


def test_jaccard_group_over_many_tiles(spark, monkeypatch):
    """A chain and a cluster of near copies that fill several tiles, so that rest and tiles meet."""
    monkeypatch.setattr(jaccard_join, "TILE", 6000)
    rng = random.Random(9)
    base, rows = prose(80, rng).split(), []
    for i in range(40):
        base[i * 2] = f"step{i}"
        rows.append((100 + i, " ".join(base), "en", "s"))
    other = prose(90, rng).split()
    for i in range(25):
        copy = list(other)
        copy[rng.randrange(90)] = f"own{i}"
        rows.append((300 + i, " ".join(copy), "en", "s"))
    rng.shuffle(rows)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert tuples(jaccard_join.jaccard_components(df, 3, 90, 100, broadcast_bytes=0)) == brute_components(rows, 3, 90, 100)


@pytest.mark.parametrize("chunk", [1, 50, 10**6])
def test_shared_keys_join_what_a_key_joins(spark, monkeypatch, chunk):
    """Components of the packed keys' pairs against those of whole keys; one key is in every third row, some are twice in a row."""
    monkeypatch.setattr(jaccard_join, "CHUNK_KEYS", chunk)
    monkeypatch.setattr(jaccard_join, "PAIRS", 7)
    rng = random.Random(chunk)
    keys = [rng.randrange(-2**63, 2**63) for _ in range(300)]
    rows = [((i % 5 << 33) + i, ([keys[0]] if i % 3 == 0 else []) + [rng.choice(keys[1:]) if rng.random() < 0.1 else rng.randrange(-2**63, 2**63) for _ in range(4)] * (1 + i % 2))
            for i in range(400)]
    graph, parent = defaultdict(list), {r: r for r, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, ks in rows:
        for k in ks:
            graph[k].append(r)
    for members in graph.values():
        for m in members:
            a, b = sorted((root(m), root(members[0])))
            parent[b] = a
    frame = spark.createDataFrame(rows, "row long, keys array<long>").repartition(3)
    found = {r.node: r.root for r in common.components(jaccard_join._shared_keys(frame, 10**9)).collect()}
    groups = lambda of: sorted(sorted(g) for g in by(of).values() if len(g) > 1)

    def by(of):
        out = defaultdict(list)
        for r, _ in rows:
            out[of(r)].append(r)
        return out

    assert groups(root) == groups(lambda r: found.get(r, r))


@pytest.mark.parametrize("rows_of_a_chunk", [1, 7, 512])
def test_passages_of_all_documents_join_nothing(spark, monkeypatch, rows_of_a_chunk):
    """All texts share a passage, some are near copies: links stay, and most other sets share no key that they show."""
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", rows_of_a_chunk)
    rng, words = random.Random(31), jaccard_join.Words()
    passage, texts = [f"p{i}" for i in range(45)], []
    for i in range(80):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(90, 140))]
        texts.append(own + passage)
        if i % 10 == 0:
            for k in range(4):
                texts.append(own[:80] + [f"x{i}.{k}"] + own[81:] + passage)
    rng.shuffle(texts)
    sets = [jaccard_join.shingle_set(" ".join(t).encode(), 5, words) for t in texts]
    rows = [((i % 3 << 33) + i, len(s), jaccard_join.part_keys(s, 0.8).view(np.int64).tolist()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "row long, n_shingles int, keys array<long>")
    whole = {r.node: r.root for r in common.components(jaccard_join._shared_keys(frame.select("row", "keys"), 10**6)).collect()}
    rare = jaccard_join._rare_keys(frame, 10**6, 0.8)
    assert rare.columns == ["row", "keys"]
    found = {r.node: r.root for r in common.components(jaccard_join._shared_keys(rare, 10**6)).collect()}
    assert max(Counter(whole.values()).values()) == len(sets)
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                links += 1
                assert found[rows[i][0]] == found[rows[j][0]]
    assert links == 80 and max(Counter(found.values()).values()) < len(sets) / 4


def test_bands_cover_every_link():
    for similarity in (0.8, 0.9):
        for b in range(1, 400):
            for a in range(1, b + 1):
                differ = int((1 - similarity) / (1 + similarity) * (a + b) + 1e-9)
                if a >= similarity * b and differ:
                    shared = set(jaccard_join.bands(a, similarity)) & set(jaccard_join.bands(b, similarity))
                    assert any(parts - differ > slack for _, parts, slack, _ in shared), (a, b)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(6)
    for similarity, size in [(0.8, n) for n in (5, 9, 20, 75, 400, 2500)] + [(0.9, n) for n in (10, 30, 150, 1200)]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
            differ = int((1 - similarity) / (1 + similarity) * 2 * len(a))
            gone = rng.integers(0, differ // 2 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**64, differ // 2 - gone, np.uint64, endpoint=False)]))
            both = len(np.intersect1d(a, b))
            if both >= similarity * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert set(jaccard_join.part_keys(a, similarity).tolist()) & set(jaccard_join.part_keys(b, similarity).tolist())


# Line dedup -----------------------------------------------------------------------------------------------

def brute_lines(rows, least):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    spans = []
    for k, (i, t, *_) in enumerate(rows):
        lines = (t or "").encode().split(b"\n")
        at = [x for x, line in enumerate(lines) if line.split()]
        out.append((i, len(lines) if t else 0, set()))
        for a in range(len(at)):
            words = 0
            for b in range(a, len(at)):
                words += len(lines[at[b]].split())
                if words >= least:
                    spans.append((k, at[a:b + 1], tuple(lines[x].strip() for x in at[a:b + 1])))
                    break
    for k, span, content in spans:
        if content in seen:
            out[k][2].update(span)
        seen.add(content)
    return Counter((i, n, tuple(sorted(gone))) for i, n, gone in out)


@pytest.mark.parametrize("least", [3, 10, 25])
def test_repeated_lines(docs, least):
    got = Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in line_dedup.repeated_lines(docs, least).collect())
    assert got == brute_lines(ROWS, least)


def test_lines_of_many_copies(spark, empty):
    rng = random.Random(2)
    lines = [prose(rng.randint(1, 6), rng) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 15)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in line_dedup.repeated_lines(df, 8, broadcast_bytes=0).collect())
    assert got == brute_lines(rows, 8)
    assert line_dedup.repeated_lines(empty).count() == 0 and line_dedup.drop_repeated_lines(empty).count() == 0


def brute_whole_runs(rows, least):
    """Every stretch of enough words, of any length, against all earlier ones."""
    seen, out = set(), Counter()
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        at, gone = [x for x, line in enumerate(lines) if line.split()], set()
        for a in range(len(at)):
            for b in range(a, len(at)):
                if sum(len(lines[x].split()) for x in at[a:b + 1]) >= least:
                    content = tuple(lines[x].strip() for x in at[a:b + 1])
                    gone.update(at[a:b + 1] if content in seen else ())
                    seen.add(content)
        out[(i, len(lines) if t else 0, tuple(sorted(gone)))] += 1
    return out


def test_whole_runs(spark, empty):
    """Also the short end of a copied passage goes, where the text goes on differently and where it ends."""
    rng = random.Random(4)
    long, short = prose(20, rng), prose(2, rng)
    rows = [(1, f"{long}\n{short}\n{prose(9, rng)}"), (2, f"{long}\n{short}\nother {prose(8, rng)}"), (3, f"new {prose(3, rng)}\n{long}\n\n  {short} "), (4, short), (5, None)]
    lines = [prose(rng.randint(1, 6), rng) for _ in range(12)]
    rows += [(10 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 15)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (8, 10, 25):
        got = {r.doc_id: r for r in line_dedup.repeated_lines(df, least, broadcast_bytes=0, whole=True).collect()}
        assert Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in got.values()) == brute_whole_runs(rows, least)
        assert least == 25 or (got[2].removed, got[3].removed, got[4].removed) == ([0, 1], [1, 3], [])
    assert line_dedup.repeated_lines(empty, whole=True).count() == 0
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df.where("doc_id < 3")).collect()}
    assert short in cut[1].split("\n") and short not in cut[2].split("\n")


def test_stretches_of_removed_lines(spark):
    """Two copied passages apart are two stretches; passages of different texts that follow each other are one."""
    a, b = [f"{LINE} {i} {j}" for i in (1,) for j in range(3)], [f"{LINE} {i} {j}" for i in (2,) for j in range(2)]
    texts = ["\n".join(a), "\n".join(b), "\n".join([*a, "new", *b]), "\n".join([*a, *b])]
    rows = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), whole=True).collect()
    assert {r.doc_id: (r.removed, r.runs) for r in rows} == {0: ([], 0), 1: ([], 0), 2: ([0, 1, 2, 4, 5], 2), 3: ([0, 1, 2, 3, 4], 1)}


def test_lines_are_cut(docs):
    cut = line_dedup.drop_repeated_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    text = {r.doc_id: r.text for r in cut.where("doc_id IN (7, 8)").collect()}
    assert text[7].count(LINE) == 1 and LINE not in text[8] and len(text[8]) == cut.where("doc_id = 8").first().n_chars


# Mixing -----------------------------------------------------------------------------------------------------

def test_permutation_and_inverse():
    for n in (1, 2, 3, 10, 257, 1000):
        at = np.arange(n)
        sent = mixing.permute(at, n, 1, 2, 3)
        assert sorted(sent) == list(at) and (mixing.permute(sent, n, 1, 2, 3, back=True) == at).all()


def test_mix(docs, empty):
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(words_of(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    level, capped = 0.0, set()
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not more:
            break
        capped |= more
    rows = mixing.mix(docs, block_words=16, shard_blocks=8).collect()
    assert len(rows) == len(ROWS)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert abs(r.target - min(3 * sizes[r.source], level * weight[r.source])) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 32 for r in rows)
    assert tuples(mixing.mix(docs, block_words=16, shard_blocks=8)) == Counter(map(tuple, rows))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_shards_are_drawn_whole(docs):
    plan = mixing.source_plan(mixing.count_words(docs, "doc_id", "text", "source"), block_words=16)
    quota = {r.idx: r.quota for r in plan.collect()}
    slots = mixing.draw_slots(plan, shard_blocks=8)
    assert Counter(r.idx for r in slots.collect()) == Counter({k: v for k, v in quota.items() if v})
    assert slots.groupBy("idx", "slot").count().where("count > 1").count() == 0


def test_shards_hold_what_a_brute_draw_puts_there(docs):
    """Words of each source in each shard, in the order of its slots, against a draw over whole word lists."""
    block_words, shard_blocks, seed = 16, 8, mixing.SEED
    words = defaultdict(list)
    for key, text, _, source in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        words[source] += words_of(text)
    plan = {r.source: r for r in mixing.source_plan(mixing.count_words(docs, "doc_id", "text", "source"), block_words=block_words).collect()}
    shards = max(1, -(-sum(r.quota for r in plan.values()) // shard_blocks))
    expected = defaultdict(list)
    for source, row in plan.items():
        slot = 0
        for shard, n in enumerate(np.random.default_rng([seed, row.idx, 0, shards]).multinomial(row.quota, np.full(shards, 1 / shards))):
            for slot in range(slot, slot + n):
                block = int(mixing.permute(np.array([slot % row.blocks]), row.blocks, seed, row.idx, slot // row.blocks)[0])
                expected[source, shard] += words[source][block * block_words:(block + 1) * block_words]
            slot += int(n > 0)
    found = defaultdict(list)
    out = mixing.mixed_blocks(docs, block_words=block_words, shard_blocks=shard_blocks)
    assert out.columns == [*docs.columns, "shard", "slot"]
    for r in sorted(out.collect(), key=lambda r: (r.slot, r.doc_id is not None, r.doc_id or 0)):
        found[r.source, r.shard] += words_of(r.text)
    # documents with one id (their texts are equal) may stand in either order, so words of a shard are compared as a multiset too
    assert {k: Counter(v) for k, v in found.items()} == {k: Counter(v) for k, v in expected.items()} and len(found) > shards
    assert mixing.mixed_blocks(docs.withColumnRenamed("row", "shard"), block_words=block_words).columns[-2:] == ["shard_", "slot"]


def test_mixed_documents_hold_what_the_mix_takes(docs):
    taken, out = Counter(), Counter()
    for r in mixing.mix(docs, block_words=16).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        out[r.doc_id] += len(words_of(r.text))
        assert r.n_chars == len(r.text)
    assert out == +taken


# Quality ------------------------------------------------------------------------------------------------------

def test_linear_time_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    machine = factor_machine.Machine(0.2, rng.normal(size=factor_machine.FEATURES), rng.normal(size=(factor_machine.FEATURES, 3)) / 10)
    at, x = factor_machine.features(b"Some words, some more words!\nand a line", factor_machine.Words())
    pairs = sum(machine.factors[i] @ machine.factors[j] * x[a] * x[b] for a, i in enumerate(at) for b, j in enumerate(at) if a < b)
    raw = machine.bias + machine.weights[at] @ x + pairs
    assert abs(machine.score(at, x) - 1 / (1 + np.exp(-raw))) < 1e-9


def test_quality_on_hard_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (10, 1), (10, 1), (99, 0)], "doc_id long, quality int")
    machine = factor_machine.fit_quality(docs, labels)
    scores = factor_machine.quality_scores(docs, machine).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores)
    assert len({r.score for r in scores if r.doc_id in (4, 5)}) == 1
    kept = factor_machine.keep_quality(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in scores)
    nothing = factor_machine.fit_quality(empty, labels.limit(0))
    assert factor_machine.quality_scores(empty, nothing).count() == 0 and factor_machine.keep_quality(docs, nothing).count() == len(ROWS)


def test_fit_takes_one_row_of_an_id(spark, monkeypatch):
    """Many rows of one chosen id, of different and of equal texts, give one row to the driver; it is the same in any order of rows."""
    fitted = []
    monkeypatch.setattr(factor_machine, "fit", lambda rows, labels: fitted.append((rows, labels)))
    texts = [prose(5) for _ in range(50)] * 4 + [None]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for order in (texts, texts[::-1]):
        factor_machine.fit_quality(spark.createDataFrame([(1, t) for t in order], "doc_id long, text string").repartition(4), labels, fit_rows=1)
    (one, first), (two, second) = fitted
    assert len(one) == len(two) == 1 and list(first) == list(second) == [1]
    assert (one[0][0] == two[0][0]).all() and (one[0][1] == two[0][1]).all()


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) > 40
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) >= 0.93


# URLs -----------------------------------------------------------------------------------------------------------

def test_urls(spark):
    urls = ["HTTPS://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org", "http://notexample.org/es/", None, "no scheme", "", "x://", "http://shop.com/de/1",
            "http://shop.com/fr/1", "http://www.listed.net/a/?utm_source=x&b=2&a=1#t", "http://listed.net/a?a=1&b=2", "http://listed.net/a", "http://shop.com/fr/1", "s://h.org/" + "p" * 20000]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
                                   ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://listed.net/a/?b=2&a=1",), (None,), ("nothing",)], "url string")
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, "allow"),
            ("notexample.org", "/es/", "org/", "allow"), *[("", "", None, "allow")] * 4, ("shop.com", "/de/1", "com/de/", "block"), ("shop.com", "/fr/1", "com/fr/", "allow"),
            ("www.listed.net", "/a/", None, "block"), ("listed.net", "/a", None, "block"), ("listed.net", "/a", None, "allow"), ("shop.com", "/fr/1", "com/fr/", "allow"),
            ("h.org", "/" + "p" * 20000, "org/", "allow")]
    want = Counter((i if i != 3 else None, *w) for i, w in enumerate(want))
    for size in (common.BROADCAST_BYTES, 0):
        got = url_filter.judge_urls(pages, rules, listed, broadcast_bytes=size)
        assert tuples(got.select("page_id", "host", "path", "rule", "verdict")) == want
    assert url_filter.judge_urls(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


# Secrets --------------------------------------------------------------------------------------------------------

def test_secrets(docs, empty, spark):
    found = secret_scan.scan(docs, vocabulary_path())
    secrets = found.where("secret").collect()
    assert [(r.doc_id, r.at, r.length) for r in secrets] == [(13, 9, 40)]
    assert secret_scan.scan(empty, vocabulary_path()).count() == 0
    big = secret_scan.candidates(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), vocabulary_path())
    labels = secret_scan.weak_labels(big)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    forest = secret_scan.fit_forest(big, labels.where(fold == 0))
    judged = secret_scan.judge(big, forest).join(labels.where(fold == 1), ["doc_id", "at"]).select("secret", "label").collect()
    assert sum(r.secret == (r.label == 1) for r in judged) >= 0.98 * len(judged) and any(r.secret for r in judged)


def test_named_values_of_any_characters():
    text = b'password = "S3cr3t12pass"; pwd: p@ss:w0rd!&%x, see https://bob:hunter2!x@db.example.net/ and "api_key": "a b3 c$"; private=short passwd=\'12345\''
    found = {text[a:b]: named for a, b, named in secret_scan.spans(text)}
    assert found == dict.fromkeys((b"S3cr3t12pass", b"p@ss:w0rd!&%x", b"hunter2!x", b"a b3 c$"), True)
    assert len(secret_scan.spans(b"key=" * 20000)) < 20000


def test_planted_secrets(spark):
    """Secrets that stand bare and short or odd named ones are found in documents that the forest is not fitted on; words, paths and numbers not."""
    rng, rows, where = random.Random(12), [], {}
    letters, upper = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    kinds = {
        "hex": (lambda: draw(40, "0123456789abcdef"), 'token = "{}"'), "short": (lambda: draw(9) + "7x", 'password = "{}"'), "odd": (lambda: f"{draw(5)}!{draw(4)}&9{draw(3)}%", "passwd: {}"),
        "user": (lambda: draw(9) + "4", "https://bob:{}@db.net/x"), "key id": (lambda: "AKIA" + draw(16, upper), "the id is {} as it was"), "cell": (lambda: "ghp_" + draw(36), "| name | {} |"),
        "bare": (lambda: draw(36) + "5e", "it is {} today"), "in url": (lambda: "ghp_" + draw(36), "http://a.net/x?q={}"),
        "word": (lambda: "".join(rng.choice(WORDS) for _ in range(5)), "so {} was"), "path": (lambda: "/".join(rng.choice(("account", "library", "version2", "source", "window")) for _ in range(4)), "in {} lies"),
        "number": (lambda: draw(16, "0123456789"), "number {} of"),
    }
    for i in range(660):
        kind = list(kinds)[i % len(kinds)]
        value, form = kinds[kind][0](), kinds[kind][1]
        text = f"{prose(8, rng)} {form.format(value)} {prose(5, rng)}"
        rows.append((i, text))
        where[i] = kind, text.index(value), len(value)
    flagged = defaultdict(list)
    for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary_path()).where("secret").collect():
        flagged[r.doc_id].append((r.at, r.at + r.length))
    hits, all_ = Counter(), Counter()
    for i, (kind, at, n) in where.items():
        if zlib.crc32(str(i).encode()) % 5 == 0:
            all_[kind] += 1
            hits[kind] += any(a <= at and at + n <= b for a, b in flagged[i])
    for kind in kinds:
        assert all_[kind] > 3 and (hits[kind] <= 0.1 * all_[kind] if kind in ("word", "path", "number") else hits[kind] >= 0.8 * all_[kind]), (kind, hits, all_)


# Nearest neighbours ---------------------------------------------------------------------------------------------

def test_hilbert_curve_is_a_path():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_hard_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [1.0] * 3), (None, [1.0] * 8), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, node string")
    got = defaultdict(list)
    for r in sorted(hilbert_ann.nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((float((x[q] * v).sum()), i) for i, v in x.items() if i != q), key=lambda p: (-p[0], p[1]))[:20]
        assert [i for i, _ in found] == [i for _, i in want] and np.allclose([s for _, s in found], [s for s, _ in want])
    few = hilbert_ann.nearest(df.where("vec_id IN (0, 1, 20)"), F.col("vec_id") % 20 == 0).collect()
    assert Counter(r.query_id for r in few) == {0: 2, 20: 2}
    assert hilbert_ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "TILE", 64)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = defaultdict(set)
    for r in hilbert_ann.nearest(vectors, F.col("vec_id") % 20 == 0, reach=0).collect():
        found[r.query_id].add(r.vec_id)
    ids, x = map(np.array, zip(*[(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -9
        hits += len(found[ids[i]] & set(ids[np.argsort(-score)[:20]]))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


# Helpers, queries, pipeline ---------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 300)] + [(400, 400)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[root(a)] = root(b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(parent)
    assert len(set(got.values())) == len({root(x) for x in parent}) and len({(got[x], root(x)) for x in parent}) == len(set(got.values()))


def test_bloom_has_no_false_negatives(spark):
    keys, other = spark.range(5000), spark.range(100000, 105000)
    made = common.bloom_filter(keys, F.col("id"), 5000)
    hit = common.bloom_hits(keys.unionByName(other), F.col("id"), made, 5000, "hit")
    counts = {r.old: r.n for r in hit.groupBy((F.col("id") < 5000).alias("old")).agg(F.count_if("hit").alias("n")).collect()}
    assert counts[True] == 5000 and counts[False] < 500


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    from compare import difference, duck

    assert difference(spark, duck(SF), QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_stages(spark, docs, empty):
    """Each stage of the pipeline on hard cases and on nothing."""
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, empty):
            out = stage(spark, given, SF)
            assert i == 4 or out.columns == docs.columns
            assert (out.count() > 0) == (given is docs)


def test_pipeline(spark, library):
    sf = "/root/testdata/sf0.01"  # enough labels to fit on
    out = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in out}
    assert len(kept) > 500 and len({texts[i].lower() for i in kept}) == len(kept)
    assert sum(labels.get(i, 1) for i in kept) > 0.97 * len(kept)
    for r in out[:20]:
        back = library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
        assert hashlib.sha256(back.encode()).hexdigest() == r.decoded_sha256 and r.n_tokens == len(r.ids) // 4
