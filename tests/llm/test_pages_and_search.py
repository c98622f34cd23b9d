"""Hard negatives, lexical search and page texts against brute force on small hard cases, on empty tables and against their SQL."""

import math
import random
import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compare import difference, duck
from conftest import SF
from shelfsense.llm import hard_negatives, hilbert_ann, html_text, lexical_search
from shelfsense.llm.queries import ORACLES, QUERIES

RNG = random.Random(11)


def tuples(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lexical_search"])
def test_matches_sql(spark, name):
    assert difference(spark, duck(SF), QUERIES[name], ORACLES[name], SF) is None


# Hard negatives ---------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
                        *[T.StructField(c, T.StringType()) for c in ("row", "score", "cells", "part", "a", "top", "low", "rank", "windows")]])


def vector_rows(n, dims=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).round(2).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    same = rows[1][1]
    rows += [(1000 + i, same, i % 4) for i in range(40)]  # a large group of equal vectors, ties by id
    rows += [(20, [0.0] * dims, 1), (40, [float("nan")] * dims, 1), (41, [float("inf")] + [0.0] * (dims - 1), 1), (42, None, 1), (43, [None] * dims, 1),
             (44, [1.0] * dims, None), (None, [1.0] * dims, 1), (50, [], 1), (60, [1.0, 2.0], 0), (61, [1.0, 1.5], 1), (62, [2.0, 2.0], 0), (63, [0.9, 1.9], 2)]
    rows += [rows[10], rows[10], rows[3]]  # repeated rows, one of them an anchor
    return rows


def brute_negatives(rows, anchor, k=5):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, v, y in ok:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in ok if j != i and len(w) == len(v)))
        for s, j, _ in [x for x in scored if x[2] == y][:k]:
            fits = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out.update((i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits))
    return out


@pytest.mark.parametrize("part_rows", [16, 100_000])
def test_hard_negatives(spark, monkeypatch, part_rows):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 2)  # many cells, so that searches end early
    monkeypatch.setattr(hard_negatives, "FIRST_CELLS", 2)
    monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    monkeypatch.setattr(hard_negatives, "SLICE_ANCHORS", 7)
    rows = vector_rows(120)
    df = spark.createDataFrame([(*r, *[None] * 9) for r in rows], VECTORS).repartition(3)
    report = []
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), part_rows=part_rows, report=report)
    assert tuples(got) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert {r["same_label"] for r in report} == {True, False}


def test_hard_negatives_stop_early_on_clusters(spark, monkeypatch):
    """In clustered vectors certified searches leave most cells unseen."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.02).tolist(), i // 12 % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    report = []
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"), report=report)
    assert tuples(got) == brute_negatives(rows, lambda i: i % 50 == 0)
    cells = report[-1]["cells"][0]
    assert sum(r["cells_asked"] for r in report if r["same_label"]) < 0.6 * 12 * max(cells, 40)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    none = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_visit_is_in_falling_order_and_complete():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, size=(400, 10)).astype(float)
    books = hard_negatives.Codebooks(x, 6)
    (a, da), (b, db) = books.place(x)
    radii = {10: ({c: da[a == c].max() for c in set(a.tolist())}, {c: db[b == c].max() for c in set(b.tolist())})}
    cells = Counter(zip(a.tolist(), b.tolist()))
    index = hard_negatives.Index(books, radii, {(10, *c): (0, 1) for c in cells})
    q, inf = x[7], float("inf")
    order = list(index.visit(q, 0, 10 ** 6, -inf, inf))
    assert sorted(order) == sorted(cells)
    best = {c: max(x[i] @ q for i in range(400) if (a[i], b[i]) == c) for c in cells}
    for floor in (0, 50_000, 120_000):
        seen = set(index.visit(q, 0, 10 ** 6, floor, inf))
        assert all(best[c] < floor for c in cells if c not in seen)
    assert list(index.visit(q, 0, 3, -inf, inf)) + list(index.visit(q, 3, 99, -inf, inf)) == order


@pytest.mark.parametrize("odd", [4, 1])
def test_nearest_of_an_odd_length_takes_no_part(spark, odd):
    """One vector of another length, longer or shorter, changes nothing for the others."""
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(40)]
    alone = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    mixed = hilbert_ann.nearest(spark.createDataFrame([*rows, (60, [1.0] * odd)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert tuples(mixed) == tuples(alone) and sum(tuples(alone).values()) == 40


# Lexical search ---------------------------------------------------------------------------------------

def brute_search(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(Counter)
    for i, t in items:
        wanted[i].update(term.findall((t or "").translate(lower)))
    out = Counter()
    for i, query in wanted.items():
        scored = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms if c else 1
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in query.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out.update((i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k]))
    return out


SEARCHED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("id", "item", "score", "term")]])


def search_rows():
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "x-y", "Ä", "ä", "naïve", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(RNG.choices(words, weights, k=RNG.randint(1, 80)))) for i in range(300)]
    docs += [(900 + i, "W0 w1 w2 w59") for i in range(60)]  # a group of copies: ties
    docs += [(1, None), (2, ""), (3, " \n-"), (None, "w59 w58"), (None, "w59 w58"), (7, "w50 " * 4000), (8, "y" * 50_000), (9, "w1 w2 w3\u0085w4")]
    items = [(i, " ".join(RNG.choices(words, k=12))) for i in range(15)] + [(3, "w59 w59 w7"), (50, None), (51, ""), (52, "unseen"), (None, "w58 w0"), (53, "W0 w0 W1"), (54, "w0 " * 30 + "w59")]
    return docs, items


@pytest.mark.parametrize("block, pass_terms", [(4_096, 200_000), (16, 200_000), (64, 20)])
def test_lexical_search(spark, monkeypatch, block, pass_terms):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    docs, items = search_rows()
    df = spark.createDataFrame([(*d, *[None] * 4) for d in docs], SEARCHED).repartition(3)
    got = lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"), pass_terms=pass_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert tuples(got) == brute_search(docs, items)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], SEARCHED), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    full = spark.createDataFrame([(1, "w1", *[None] * 4)], SEARCHED)
    assert lexical_search.search(full, items.limit(0)).count() == 0 and lexical_search.search(full, items).count() == 1


def test_accumulators_stop_and_scores_stay_exact():
    rng = np.random.default_rng(3)
    n = 3_000
    postings = {t: (np.flatnonzero(rng.random(n) < share).astype(np.int32), None) for t, share in enumerate((0.01, 0.02, 0.3, 0.9, 1.0))}
    postings = {t: (at, rng.integers(1, w, len(at))) for (t, (at, _)), w in zip(postings.items(), (9_000, 8_000, 900, 30, 3))}
    query, k = [(0, 2), (1, 1), (2, 1), (3, 1), (4, 2)], 20
    full = np.zeros(n, np.int64)
    for t, times in query:
        full[postings[t][0]] += times * postings[t][1]
    scores = np.zeros(n, np.int64)
    assert lexical_search.accumulate(query, postings, scores, k, 0) > 1_000  # postings of documents that cannot win were passed over
    kth = np.sort(full)[-k]
    assert (scores[full >= kth] == full[full >= kth]).all() and (scores <= full).all()


# Page texts -------------------------------------------------------------------------------------------

def page(*body, head="<title>t</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{''.join(body)}</body></html>"


CASES = [
    (None, []),
    ("", []),
    ("plain &amp; simple\n text", ["plain & simple text"]),
    (page("<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><h1>T &lt; U</h1><p><b>One.<br><p>Two&nbsp; 2</p></article><footer>&copy; us</footer>"), ["T < U", "One.", "Two 2"]),
    (page("<div id='siteHeader'>Brand</div><div class='post-content'><p>Body</p><div class='ad'>Buy</div><p>More <span class='sponsored'>ad <b>x</b></span> text</p></div><div id='comments'><p>First!</p></div>"), ["Body", "More text"]),
    (page("<main><h1>Head</h1><aside>Side</aside><p>Para</p><form><label>Mail</label><button>Go</button></form></main><p>after</p>"), ["Head", "Para"]),
    (page("<main><article><header><h1>H</h1></header><p>A</p><section class='reader-comments'><article>no</article></section></article></main>"), ["H", "A"]),
    (page("<div class='with-sidebar'><p>Kept</p></div><div class='cookie-notice'>We use cookies</div><p hidden>gone</p><p style='display: none'>gone</p>"), ["Kept"]),
    (page("<header>Site</header><p>a &lt;b&gt; c &#233; &bogus; &am</p><!-- <p>no</p> --><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"), ["a <b> c é &bogus; &am", "1 2", "3"]),
    ("<p>unclosed <article><p>in</div></span><p class=ad>buy<p>rest", ["in", "rest"]),
    (page("<article>" + "<p>x</p>" * 20_000 + "</article>"), ["x"] * 20_000),
    ("<a" * 100_000, ["<a" * 100_000]),
    (page("<div>" * 20_000 + "deep"), ["deep"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_blocks(case):
    html, want = CASES[case]
    found = html_text.Page("h", html or "")
    assert (found.article if found.level != html_text.OPEN else [found.others[i][1] for i in found.free]) == want


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      *[T.StructField(c, T.StringType()) for c in ("host", "text", "key", "row", "gone", "at", "texts", "low", "high")]])


def div_page(i, host):
    """A page without any marks: what repeats on the host is boilerplate."""
    return page(f"<div>Menu of {host}</div><div>Home News Sport Weather</div><p>Story {i} begins with words</p>", f"<p>Short {i % 2}</p><p>and number {i} goes on</p>",
                f"<div>All rights of {host} are reserved here</div>")


def test_main_texts(spark):
    rows = [(i, f"http://a.org/{i}", div_page(i, "a.org")) for i in range(6)]
    rows += [(10, "https://b.org/1", div_page(10, "b.org")), (11, "https://c.org/1", div_page(11, "c.org")), (12, "https://c.org/1?x", div_page(11, "c.org"))]
    rows += [(20 + i, "http://d.org/x", CASES[3][0]) for i in range(3)] + [(None, None, None), (30, "nohost", ""), (None, None, "<p>x</p>")]
    rows += [(40, "http://e.org/1", page("<article><p>the same article on two pages of a host</p></article><div>Menu one two three four</div>")),
             (41, "http://e.org/2", page("<article><p>the same article on two pages of a host</p><p>and more</p></article><div>Menu one two three four</div>"))]
    df = spark.createDataFrame([(*r, *[None] * 9) for r in rows], PAGES).repartition(3)
    want = Counter()
    for i, url, html in rows:
        if url and "a.org" in url:
            text = f"Story {i} begins with words\n\nShort {i % 2}\n\nand number {i} goes on"
        elif url and ("b.org" in url or "c.org" in url):
            host, n = url[8:13], 10 if "b.org" in url else 11  # one page, or one page twice: nothing repeats on distinct pages
            text = f"Menu of {host}\n\nHome News Sport Weather\n\nStory {n} begins with words\n\nShort {n % 2}\n\nand number {n} goes on\n\nAll rights of {host} are reserved here"
        else:
            p = html_text.Page("", html or "")
            text = "\n\n".join(p.article or [p.others[j][1] for j in p.free])
        want[i, url, text, len(text)] += 1
    for size in (1 << 20, 0):  # flags broadcast, and joined
        got = html_text.main_texts(df, broadcast_bytes=size)
        assert tuples(got.select("page_id", "url", "text", "n_chars")) == want
    assert {r.n_repeated for r in got.where("page_id in (40, 41)").collect()} == {1}
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_repeated_blocks_is_exact(spark):
    """Against all maximal common runs of all pairs of pages, on streams of few tokens."""
    rng = random.Random(4)
    streams = [(bytes([i]), [rng.randrange(6) for _ in range(rng.randrange(1, 12))], i) for i in range(25)]
    streams = [(k, t, sorted(rng.sample(range(len(t) + 3), len(t))), [1 + x % 3 for x in t], p) for k, t, p in streams]
    df = spark.createDataFrame([(*s[:4], s[4], s[4]) for s in streams], "key binary, tokens array<long>, places array<int>, words array<int>, low long, high long")
    want = {}
    for k, t, at, words, p in streams:
        gone = [False] * len(t)
        for k2, t2, at2, _, _ in streams:
            if k2 == k:
                continue
            for i in range(len(t)):
                for j in range(len(t2)):
                    n = 0
                    while i + n < len(t) and j + n < len(t2) and t[i + n] == t2[j + n] and at[i + n] == at[i] + n and at2[j + n] == at2[j] + n:
                        n += 1
                    if sum(words[i:i + n]) >= 5:
                        gone[i:i + n] = [True] * n
        if any(gone):
            want[k] = gone
    assert {bytes(r.key): r.gone for r in html_text.repeated_blocks(df, 5).collect()} == want


def test_given_pages(spark):
    got = {r.page_id: r for r in QUERIES["op13_html_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", p.html, re.S)[1])
        assert " ".join(got[p.page_id].text.split()) == " ".join(unescape(inner).split()) and got[p.page_id].n_chars == len(got[p.page_id].text)
