"""Trained models reach sensible accuracy on held-out or labelled rows."""

from conftest import SF

from shelfsense.operators import models
from shelfsense.plans.testviews import table


def test_language(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = models.train_language(docs.where("doc_id % 2 = 0"))
    out = models.detect_language(model, docs.where("doc_id % 2 = 1")).collect()
    assert sum(r["lang"] == r["detected_lang"] for r in out) / len(out) > 0.9
    assert all(0 < r["lang_conf"] <= 1 for r in out)
    blank = models.detect_language(model, spark.createDataFrame([("  ",), (None,)], "text string")).collect()
    assert [tuple(r)[1:] for r in blank] == [("unknown", 0.0)] * 2


def test_sentiment(spark):
    rows = [(f"great love nice item{i % 3}", "positive") for i in range(30)] + [(f"bad broken awful item{i % 3}", "negative") for i in range(8)] + [
        (f"okay average plain item{i % 3}", "neutral") for i in range(8)]
    df = spark.createDataFrame(rows, "text string, sentiment_label string")
    model = models.train_sentiment(df, max_iter=30)
    out = models.predict_sentiment(model, df).collect()
    assert all(r["sentiment_label"] == r["predicted_label"] for r in out)
    assert all(abs(r["prob_negative"] + r["prob_neutral"] + r["prob_positive"] - 1) < 1e-9 for r in out)


def test_fit_holds_counts_and_no_words(spark, monkeypatch):
    rows = [(f"{word} nice{i % 3} thing", label) for i in range(20) for word, label in (("great", "positive"), ("bad", "negative"), ("plain", "neutral"))]
    df, held = spark.createDataFrame(rows, "text string, sentiment_label string"), []
    persist = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, level: held.append((dict(self.dtypes), level.useMemory)) or persist(self, level))
    models.train_sentiment(df, max_iter=5)
    assert held == [({"sentiment_label": "string", "class_weight": "double", "_tf": "vector"}, False)]
