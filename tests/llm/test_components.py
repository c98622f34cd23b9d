"""Components: what is left after any number of rounds is joined alike, and a small graph costs the driver few tables and jobs."""

import random

import pytest

from shelfsense.llm import common, jaccard_join


def graph():
    rng = random.Random(9)
    chains = [(i, i + 1) for i in range(0, 300) if i % 50] + [(2 * i + 1001, 2 * i + 1003) for i in range(40)]
    return chains + [(2000, i) for i in range(2001, 2100)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(150)] + [(-5, 2050), (7, 7)]


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[root(a)] = root(b)
    parts = {}
    for x in parent:
        parts.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, parts.values()))


@pytest.mark.parametrize("few", [0, 30, 150, 100_000])
def test_rounds_and_what_they_leave(spark, few):
    edges = graph()
    parts = {}
    for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5), few).collect():
        parts.setdefault(r.root, []).append(r.node)
    assert sorted(map(sorted, parts.values())) == brute(edges)
    assert all(root in nodes for root, nodes in parts.items())


def test_a_small_graph_is_settled_in_two_tables(spark, monkeypatch):
    made, write = [], common.saved
    monkeypatch.setattr(common, "saved", lambda df, name, *rows: made.append(name) or write(df, name, *rows))
    assert common.components(spark.createDataFrame(graph(), "a long, b long")).count()
    assert made == ["edges", "step"]


def near_copies(rng, words, copies):
    """Texts of which each differs from the first in two places at most."""
    first = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(copies):
        text = list(first)
        for _ in range(2):
            text[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(text)


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_tiles_joined_at_once_meet_no_second_time(spark, monkeypatch, broadcast_bytes):
    """Near copies that fill several tiles are one component after the first comparison: no pairs of tiles are made, and all are in the result."""
    monkeypatch.setattr(jaccard_join, "TILE", 6000)
    made, write = [], common.saved
    monkeypatch.setattr(jaccard_join, "saved", lambda df, name, *rows: made.append(name) or write(df, name, *rows))
    rows = [(i, text) for i, text in enumerate(near_copies(random.Random(5), 200, 60))] + [(100 + i, f"alone {i} and by itself") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 3, 80, 100, broadcast_bytes=broadcast_bytes).collect()}
    assert found == {i: 0 if i < 100 else i for i, _ in rows}
    assert "rest" in made and "pairs" not in made
