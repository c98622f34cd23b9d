"""Operators against plain Python on small frames, with thresholds lowered so that the skew paths run."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfsense.operators import evaluation, select, skew, splits, stats
from shelfsense.operators.dedupe import keep_first
from shelfsense.operators.quality import product_quality
from shelfsense.operators.sentiment import route_sentiment
from shelfsense.plans import chat, clean, groups, insights


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [(f"r{i}", "hot" if i % 3 == 0 else f"p{rng.randrange(40)}", rng.randrange(0, 60), i % 2 == 0, rng.randrange(0, 350)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "review_id string, product_id string, helpful_vote bigint, verified_purchase boolean, text_len int")


def test_hot_key_join_keeps_all_rows_and_spreads(spark):
    rows, df = skewed(spark)
    normal = {r["review_id"]: r for r in product_quality(df, hot_rows=10**9).collect()}
    sliced = {r["review_id"]: r for r in product_quality(df, hot_rows=50).collect()}
    assert normal == sliced and len(sliced) == len(rows)
    hot = [math.log1p(r[2]) for r in rows if r[1] == "hot"]
    one = next(r for r in rows if r[1] == "hot")
    assert sliced[one[0]]["helpful_vote_norm"] == pytest.approx((math.log1p(one[2]) - min(hot)) / (max(hot) - min(hot)))
    assert sliced[one[0]]["total_reviews"] == len(hot)


@pytest.mark.parametrize("small", [20_000, 10])
def test_order_statistics(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "SMALL", small)
    rng = random.Random(1)
    rows = [("a", float(int(rng.expovariate(0.02)))) for _ in range(30_000)] + [("a", 7.0)] * 15_000 + [("b", 1.5)] + [("b", 2.5)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = {"p50": 0.5, "p95": 0.95, "p999": 0.999, "p0": 0.0, "p100": 1.0}
    out = {r["k"]: r for r in skew.order_statistics(df, ["k"], "v", {k: (p, F.floor((F.col("n") - 1) * p)) for k, p in ps.items()}).collect()}
    assert set(out) == {"a", "b"}
    for key, row in out.items():
        values = sorted(v for k, v in rows if k == key and v is not None)
        for name, p in ps.items():
            assert row[name] == values[math.floor((len(values) - 1) * p)]


@pytest.mark.parametrize("low, high", [(0.9, 0.95), (0.0, 0.01), (0.4, 0.4)])
def test_order_statistics_widen_a_bracket_that_misses(spark, monkeypatch, low, high):
    """Brackets deliberately put elsewhere: counts show the miss, and the exact values still come back."""
    monkeypatch.setattr(skew, "SMALL", 50)
    monkeypatch.setattr(skew, "PARTS", 8)
    rng = random.Random(9)
    rows = [("a", rng.lognormvariate(0, 3)) for _ in range(3_000)] + [("a", 5.0)] * 500 + [("b", float(i)) for i in range(1_000)] + [("c", 1.0), ("d", None), ("e", float("inf")), ("e", -2.0)]
    df = spark.createDataFrame(rows, "k string, v double")

    def bad(shares):
        ends = F.percentile_approx("_v", [low, high], 10_000)
        return F.array(*[F.struct(ends[0].alias("low"), ends[1].alias("high")) for _ in shares])

    ps = {"p1": 0.01, "p50": 0.5, "p93": 0.93, "p100": 1.0}
    out = {r["k"]: r for r in skew.order_statistics(df, ["k"], "v", {k: (p, F.floor((F.col("n") - 1) * p)) for k, p in ps.items()}, bad).collect()}
    assert set(out) == {"a", "b", "c", "e"}
    for key, row in out.items():
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert {name: row[name] for name in ps} == {name: values[math.floor((len(values) - 1) * p)] for name, p in ps.items()}


def test_order_statistics_group_only_what_is_in_a_bracket(spark, monkeypatch):
    """The rows of the value-wise grouping are those inside the brackets, not all distinct values."""
    monkeypatch.setattr(skew, "SMALL", 100)
    df = spark.range(50_000).select(F.lit("a").alias("k"), (F.col("id") * 1.5).alias("_v"))
    brackets = spark.createDataFrame([("a", 0, 30_000.0, 30_060.0), ("a", 1, 70_000.0, 70_030.0)], "k string, share int, low double, high double")
    assert skew._inside(df, brackets, ["k"]).count() == 41 + 20
    counts = {r.share: (r["_below"], r["_rows"]) for r in skew._counts(df, brackets, ["k"], 2).collect()}
    assert counts == {0: (20_000, 41), 1: (46_667, 20)}


def test_latencies(spark):
    rng = random.Random(2)
    values = [rng.random() * 500 for _ in range(101)]
    df = spark.createDataFrame([("k", v, 200 if i % 4 else 500) for i, v in enumerate(values)], "key string, latency_ms double, status int")
    ordered = sorted(values)
    assert stats.latency_floor(df, ["key"]).first()["p50_ms"] == round(statistics.median(values), 2)
    assert stats.latency_floor(df, ["key"]).first()["p95_ms"] == round(ordered[int(0.95 * 100)], 2)
    near = stats.latency_nearest(df, ["key"]).first()
    assert (near["p95_ms"], near["success_count"]) == (round(ordered[round(100 * 0.95)], 2), 75)
    assert stats.latency_linear(df, ["key"]).first()["p90_ms"] == round(ordered[90], 2)


def greedy(vectors, limit, threshold):
    """Direct scan: ids in selection order with their kept flag."""
    if len(vectors) <= limit:
        return [(i, True) for i in range(len(vectors))]
    kept, skipped = [], []
    for i, v in enumerate(vectors):
        if len(kept) == limit:
            break
        near = any(sum(a * b for a, b in zip(v, vectors[j])) >= threshold for j in kept)
        (skipped if near else kept).append(i)
    rest = [i for i in range(len(vectors)) if i not in kept]
    return sorted([(i, True) for i in kept] + [(i, False) for i in rest[: limit - len(kept)]])


@pytest.mark.parametrize("threshold", [0.2, 0.8, 0.999])
def test_diverse_selection_equals_direct_scan(spark, threshold):
    rng = random.Random(int(threshold * 10))
    groups_, rows = {}, []
    for g, size in enumerate([1, 4, 5, 12, 40, 90]):
        basis = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(2 if g % 2 else 30)]
        vectors = []
        for _ in range(size):
            v = [x + rng.gauss(0, 0.01) for x in rng.choice(basis)]
            norm = math.sqrt(sum(x * x for x in v))
            vectors.append([x / norm for x in v])
        groups_[g] = vectors
        rows += [(g, i, v) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, v array<double>").repartition(7)
    out = select.diverse_selection(df, ["g"], [F.col("i")], "i", "v", 5, threshold, block=8).collect()
    for g, vectors in groups_.items():
        got = sorted((r["i"], r["kept"]) for r in out if r["g"] == g)
        assert got == greedy(vectors, 5, threshold)
        assert sorted(r["position"] for r in out if r["g"] == g) == list(range(1, len(got) + 1))


def test_identical_vectors_fill_up_in_order(spark):
    df = spark.createDataFrame([(1, i, [1.0, 0.0]) for i in range(20)], "g int, i int, v array<double>")
    out = select.diverse_selection(df, ["g"], [F.col("i")], "i", "v", 6, 0.82, block=7).collect()
    assert sorted((r["i"], r["kept"]) for r in out) == [(0, True)] + [(i, False) for i in range(1, 6)]


def labelled(spark, sizes):
    rows = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "review_id string, sentiment_label string")


def test_stratified_split_sizes(spark):
    df = labelled(spark, {"positive": 823, "negative": 121, "neutral": 56})
    out = splits.stratified_split(df).groupBy("split", "sentiment_label").count().collect()
    sizes = {(r[0], r[1]): r[2] for r in out}
    assert sum(n for (s, _), n in sizes.items() if s == "test") == 150
    assert sum(n for (s, _), n in sizes.items() if s == "val") == 150
    assert sizes[("test", "positive")] in (123, 124) and sizes[("test", "neutral")] in (8, 9)
    assert sum(sizes.values()) == 1000


def test_split_does_not_depend_on_row_order(spark):
    df = labelled(spark, {"positive": 200, "negative": 31, "neutral": 2})
    a = {tuple(r) for r in splits.stratified_split(df).collect()}
    b = {tuple(r) for r in splits.stratified_split(df.orderBy(F.rand(1)).repartition(9)).collect()}
    assert a == b
    assert a != {tuple(r) for r in splits.stratified_split(df, seed=7).collect()}


def test_folds_partition_each_label(spark):
    out = splits.stratified_folds(labelled(spark, {"positive": 52, "negative": 7, "neutral": 5})).groupBy("sentiment_label", "fold").count().collect()
    sizes = {}
    for label, fold, n in out:
        sizes.setdefault(label, {})[fold] = n
    assert sorted(sizes["positive"].values()) == [10, 10, 10, 11, 11] and set(sizes["positive"]) == {1, 2, 3, 4, 5}
    assert sorted(sizes["negative"].values()) == [1, 1, 1, 2, 2]


def test_group_split(spark):
    df = spark.createDataFrame([(f"p{i % 30}", i) for i in range(300)], "product_id string, x int")
    out = splits.group_split(df)
    assert out.groupBy("product_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r["split"]: r["product_count"] for r in splits.split_summary(out).collect()} == {"train": 24, "val": 3, "test": 3}
    for n in (2, 3):
        with pytest.raises(ValueError):
            splits.group_split(df.where(F.col("product_id").isin(*[f"p{i}" for i in range(n)])))
    with pytest.raises(ValueError):
        splits.check_fractions(0.5, 0.6)


def test_routing_and_predictor_sees_only_open_rows(spark):
    rows = [
        ("a", "t1", "positive", 0.91, None), ("b", "t2", None, None, 5.0), ("c", "t3", None, None, 3.0), ("d", "t4", None, None, 1.0),
        ("e", "open", None, None, None), ("f", "open", None, None, 3.5), ("g", "t7", "great", 0.4, 4.0), ("h", "t8", "Positive ", 1.7, None),
    ]
    df = spark.createDataFrame(rows, "review_id string, review_text string, predicted_sentiment string, sentiment_confidence double, rating double")

    def predictor(texts):
        assert all(t == "open" for t in texts)
        return [{"sentiment_label": "negative", "sentiment_confidence": 0.88} for _ in texts]

    got = {r["review_id"]: (r["sentiment_label"], r["sentiment_source"], r["sentiment_confidence"]) for r in route_sentiment(df, predictor).collect()}
    assert got == {
        "a": ("positive", "precomputed", 0.91), "b": ("positive", "rating", 1.0), "c": ("neutral", "rating", 1.0), "d": ("negative", "rating", 1.0),
        "e": ("negative", "model", 0.88), "f": ("negative", "model", 0.88), "g": ("positive", "rating", 1.0), "h": ("positive", "precomputed", 1.0),
    }
    bad = route_sentiment(df, lambda texts: [{"sentiment_label": "odd"} for _ in texts]).where("review_id = 'e'").first()
    assert (bad["sentiment_label"], bad["sentiment_source"], bad["sentiment_confidence"]) == ("positive", "model", 1.0)
    with pytest.raises(Exception, match="one answer is needed"):
        route_sentiment(df, lambda texts: []).collect()


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 5), (4, "b", None)], "pos int, k string, t int")
    assert sorted(r["pos"] for r in keep_first(df, ["k", "t"], ["pos"]).collect()) == [1, 3, 4]


def test_demo_product_insight(spark):
    reviews = spark.createDataFrame([
        ("DEMO_R1", "P1", "Easy to use", "This air fryer is easy to use and clean.", 43, 5.0, 5, True, "positive", 0.95, None),
        ("DEMO_R2", "P1", "Good value", "Good value for a small kitchen.", 31, 5.0, 2, True, "positive", 0.9, None),
        ("DEMO_R3", "P1", "A bit loud", "It works well but the fan is a bit loud.", 41, 5.0, 1, True, "neutral", 0.75, None),
    ], "review_id string, product_id string, review_title string, review_text string, review_char_len int, rating double, helpful_vote int, "
       "verified_purchase boolean, predicted_sentiment string, sentiment_confidence double, timestamp bigint")
    row = insights.distribution(insights.routed_reviews(reviews)).first()
    assert (row["positive_count"], row["neutral_count"], row["negative_count"], row["precomputed_source"]) == (2, 1, 0, 3)
    assert (row["positive_ratio"], row["total_available_reviews"]) == (0.6667, 3)


def test_product_group_counts_cover_large_groups_only(spark):
    rows = [(f"r{i}", "p", f"text {i}", 5.0, i, 1, 30, "positive") for i in range(4)] + [("n", "p", "bad", 1.0, 0, 1, 30, "negative")]
    df = spark.createDataFrame(rows, "review_id string, product_id string, text string, rating double, helpful_vote int, verified_purchase int, text_len int, sentiment_label string")
    out = groups.product_groups(df, 2, 3, tie=["review_id"]).first()
    assert (out["review_count"], out["negative_count"], out["positive_selected_count"], out["avg_rating_from_reviews"]) == (4, 0, 2, 5.0)
    assert out["positive_reviews"] == ["text 3", "text 2"] and out["negative_review_items"] == []


def test_clean_requires_columns(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        clean.clean_fields(spark.createDataFrame([(1,)], "x int"))


def test_class_weights_and_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("a", "a")], "t string, p string")
    assert {r[0]: r[2] for r in evaluation.class_weights(df, "t").collect()} == {"a": 4 / (2 * 3), "c": 2.0}
    report = {r["label"]: r for r in evaluation.classification_report(df, "t", "p").collect()}
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"], report["b"]["support"]) == (0.0, 0.0, 0.0, 0)


def test_judge_strict(spark):
    df = spark.createDataFrame([('{"faithfulness": 9}',)], "a string")
    assert evaluation.judge_scores(df, "a").first()["valid"] is False
    with pytest.raises(Exception, match="invalid judge answer"):
        evaluation.judge_scores(df, "a", strict=True).collect()


def test_missing_turns(spark):
    df = spark.createDataFrame([(1, [("user", "q")])], "id int, messages array<struct<role:string,content:string>>")
    assert chat.prompt_and_reference(df).first()["problem"].startswith("no assistant")
    with pytest.raises(Exception, match="no assistant turn"):
        chat.prompt_and_reference(df, strict=True).collect()
    assert [r["id"] for r in chat.invalid_examples(df, "id").collect()] == [1]


def test_latencies_of_a_group_without_any(spark):
    df = spark.createDataFrame([("a", 5.0, 200), ("b", None, 500), ("b", None, 200)], "key string, latency_ms double, status int")
    out = {r["key"]: r for r in stats.latency_nearest(df, ["key"]).collect()}
    assert (out["b"]["requests"], out["b"]["success_count"], out["b"]["p95_ms"], out["a"]["p50_ms"]) == (2, 1, 0.0, 5.0)


def test_splits_name_foreign_labels(spark):
    for label in ("mixed", None):
        df = spark.createDataFrame([("r1", "positive"), ("r2", label)], "review_id string, sentiment_label string")
        for split in (splits.stratified_split, splits.stratified_folds):
            with pytest.raises(Exception, match="label outside"):
                split(df).collect()


def test_ordinals_of_hashed_positions(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("position"))
    got = [r["n"] for r in skew.dense_ordinal(df, "position", "n").orderBy("position").collect()]
    assert got == list(range(1, 5001))


def test_fitted_model_labels_open_rows_only(spark):
    from shelfsense.operators import models

    rows = [(f"great love nice item{i % 3}", "positive") for i in range(20)] + [(f"bad broken awful item{i % 3}", "negative") for i in range(9)] + [
        (f"okay average plain item{i % 3}", "neutral") for i in range(9)]
    model = models.train_sentiment(spark.createDataFrame(rows, "text string, sentiment_label string"), max_iter=30)
    df = spark.createDataFrame([("a", "bad broken awful", None, None), ("b", "bad broken awful", 5.0, None), ("c", "bad", None, "neutral")],
                               "review_id string, review_text string, rating double, predicted_sentiment string")
    got = {r["review_id"]: (r["sentiment_label"], r["sentiment_source"]) for r in route_sentiment(df, model).collect()}
    assert got == {"a": ("negative", "model"), "b": ("positive", "rating"), "c": ("neutral", "precomputed")}
    with pytest.raises(ValueError, match="no training rows"):
        models.train_sentiment(spark.createDataFrame([], "text string, sentiment_label string"))


def test_split_reads_no_text(spark):
    from conftest import SF
    from shelfsense.registry.queries import QUERIES

    assert "text:" not in QUERIES["split_stratified"](spark, SF)._jdf.queryExecution().toString()


def test_tfidf_exchanges_no_texts(spark):
    from conftest import SF
    from shelfsense.registry.queries import QUERIES

    assert "Exchange" not in QUERIES["tfidf_weights"](spark, SF)._jdf.queryExecution().executedPlan().toString()
