"""Lookups, pages and indexed search read what they need and give what a scan gives."""

import random

import pytest
from pyspark.sql import functions as F

from shelfsense.plans import catalog, search_index
from shelfsense.session import scratch_path
from shelfsense.sources import lookup


def rows_read(df):
    """Rows that the file scans of a collected frame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


@pytest.fixture(scope="module")
def laid_out(spark):
    root = scratch_path(spark, "test-lookup")
    rows = spark.range(60_000).select(F.format_string("p%06d", (F.col("id") * 7_919) % 60_000).alias("key"), F.col("id").alias("value"))
    lookup.write_lookup(rows, root, "key", number="n", files=5)
    return root


def test_lookup_reads_one_page(spark, laid_out):
    for keys in (["p000000"], ["p031234"], ["p059999", "p000001"]):
        found = lookup.read_keys(spark, laid_out, "key", keys)
        got = {r.key: r.value for r in found.collect()}
        assert got == {k: next(v for v in range(60_000) if v * 7_919 % 60_000 == int(k[1:])) for k in keys}
        assert rows_read(found) <= 2 * lookup.STEP * len(keys)
    assert lookup.read_keys(spark, laid_out, "key", ["p99", "a"]).count() == 0
    many = [f"p{i:06d}" for i in range(0, 60_000, 100)]
    assert lookup.read_keys(spark, laid_out, "key", many).count() == len(many)
    with pytest.raises(ValueError):
        lookup.read_keys(spark, laid_out, "key", ["x"] * 1_001)


def test_absent_key_opens_no_row_group(spark, laid_out):
    """A key inside the range of a file that has no such row: the filter in the footer rules its row group out."""
    absent = lookup.read_keys(spark, laid_out, "key", ["p031234x"])
    assert absent.collect() == [] and rows_read(absent) == 0


def test_numbers_ascend_in_key_order(spark, laid_out):
    ordered = [r.n for r in lookup.read_all(spark, laid_out).orderBy("key").select("n").collect()]
    assert ordered == sorted(set(ordered))


@pytest.mark.parametrize("offset, limit", [(0, 20), (999, 3), (11_990, 50), (30_000, 100), (59_990, 20), (60_000, 5), (25_000, 13_000)])
def test_page_is_offset_and_limit(spark, laid_out, offset, limit):
    page = lookup.read_page(spark, laid_out, "key", limit, offset)
    assert [r.key for r in page.collect()] == [f"p{i:06d}" for i in range(offset, min(offset + limit, 60_000))]
    assert rows_read(page) <= limit + 4 * lookup.STEP


def test_null_keys_page_first(spark):
    root = scratch_path(spark, "test-nulls")
    lookup.write_lookup(spark.createDataFrame([(None, i) for i in range(30)] + [(i, 100 + i) for i in range(70)], "key long, value long"), root, "key", step=10, files=3)
    assert [r.key for r in lookup.read_page(spark, root, "key", 10, 25).collect()] == [None] * 5 + [0, 1, 2, 3, 4]
    assert [r.key for r in lookup.read_page(spark, root, "key", 3, 60).collect()] == [30, 31, 32]
    with pytest.raises(ValueError):
        lookup.read_page(spark, root, "key", 0, 0)


@pytest.fixture(scope="module")
def products(spark):
    rng = random.Random(6)
    words = ["steel", "ring", "String", "Brand#12", "50% off", "a_b", "İstanbul", "kettle", "red", "blue", "x"]
    rows = [(f"p{i}", " ".join(rng.choices(words, k=4)), rng.choice(words), None if i % 5 == 0 else "Home & Kitchen", " ".join(rng.choices(words, k=6)).lower()) for i in range(2_000)]
    rows += [("rare", "an unheard-of thing", None, None, None), (None, "kettle", "", "", "")]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in catalog.SEARCH_COLUMNS)).cache()


def test_indexed_search_equals_scan(spark, products, monkeypatch):
    root = scratch_path(spark, "test-search")
    monkeypatch.setattr(search_index, "LIST_SPAN", 100)
    search_index.build_search_index(products, root)
    queries = ["ring", "STRING", "Brand#1_", "%off", "un_eard-of", "50%", "a_b", "x", "ab", "kettle red", "nothing like it", "home & k", "istanbul", "İsta", "p19", "\\_b", "", None, "%", "e_l"]
    for q in queries:
        got = sorted(map(repr, search_index.search_indexed(spark, root, q).collect()))
        assert got == sorted(map(repr, catalog.search(products, q).collect())), q


def test_candidates_are_near_the_hits(spark, products):
    root = scratch_path(spark, "test-candidates")
    search_index.build_search_index(products, root)
    grams = search_index.query_grams(spark, "unheard-of")
    assert search_index.candidates(spark, root, grams).count() == 1
    for q in ("kettle", "brand#12"):
        found = search_index.candidates(spark, root, search_index.query_grams(spark, q)).count()
        assert found <= 1.1 * catalog.search(products, q).count()
