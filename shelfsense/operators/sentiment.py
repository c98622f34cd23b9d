"""Sentiment of reviews: trusted labels first, then ratings, then a model for the rest only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.scoring import confidence, known_label, rating_label
from shelfsense.operators.models import predict_sentiment
from shelfsense.schemas import SENTIMENTS, column_or, require_columns

# texts -> one {"sentiment_label", "sentiment_confidence"} per text; or a struct column of these; or a fitted model of train_sentiment
Predictor = Callable[[list[str]], list[dict]] | Column | PipelineModel


def predictor_udf(predictor: Callable[[list[str]], list[dict]]):
    """The predictor as an Arrow function that skips NULL texts, so decided rows never reach the model."""

    @F.pandas_udf("sentiment_label string, sentiment_confidence double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        open_at = [i for i, text in enumerate(texts) if text is not None]
        answers = predictor([texts.iloc[i] for i in open_at]) if open_at else []
        if len(answers) != len(open_at):
            raise ValueError("one answer is needed for each text")
        labels: list = [None] * len(texts)
        confidences: list = [None] * len(texts)
        for i, answer in zip(open_at, answers):
            labels[i], confidences[i] = answer.get("sentiment_label"), answer.get("sentiment_confidence")
        return pd.DataFrame({
            "sentiment_label": pd.Series(labels, dtype=object),
            "sentiment_confidence": pd.Series(confidences, dtype="float64"),
        })

    return predict


def route_sentiment(df: DataFrame, predictor: Predictor | None = None) -> DataFrame:
    """Add ``sentiment_label``, ``sentiment_confidence`` and ``sentiment_source``.

    A valid precomputed label wins over the rating, a clear rating wins over the model. Without a predictor
    open rows become positive with full confidence. An invalid model label becomes positive, still from the model. Only open rows
    reach the predictor; a fitted model sees the lower-cased review text.
    """
    require_columns(df, ["review_text"])
    given = known_label(column_or(df, "predicted_sentiment", F.lit(None).cast("string")))
    given_confidence = confidence(column_or(df, "sentiment_confidence", F.lit(None).cast("double")))
    rated = rating_label(column_or(df, "rating", F.lit(None).cast("double")))
    decided = df.withColumn("_given", given).withColumn("_given_confidence", given_confidence).withColumn("_rated", rated)
    is_open = F.col("_given").isNull() & F.col("_rated").isNull()
    if predictor is None:
        model_label, model_confidence = F.lit("positive"), F.lit(1.0)
    elif isinstance(predictor, PipelineModel):
        kept = decided.columns
        open_rows = decided.where(is_open).withColumn("text", F.lower(F.coalesce("review_text", F.lit(""))))
        answer = F.struct(F.col("predicted_label").alias("sentiment_label"), F.col("confidence").alias("sentiment_confidence"))
        predicted = predict_sentiment(predictor, open_rows).select(*[F.col(c) for c in kept if c != "text"], answer.alias("_model"))
        none = F.lit(None).cast(predicted.schema["_model"].dataType)
        decided = decided.where(~is_open).withColumn("_model", none).select(predicted.columns).unionByName(predicted)
        model_label = F.coalesce(known_label(F.col("_model.sentiment_label")), F.lit("positive"))
        model_confidence = confidence(F.col("_model.sentiment_confidence"))
    elif isinstance(predictor, Column):
        decided = decided.withColumn("_model", F.when(is_open, predictor))
        model_label = F.coalesce(known_label(F.col("_model.sentiment_label")), F.lit("positive"))
        model_confidence = confidence(F.col("_model.sentiment_confidence"))
    else:
        text = F.when(is_open, F.coalesce(F.col("review_text"), F.lit("")))
        decided = decided.withColumn("_model", predictor_udf(predictor)(text))
        model_label = F.coalesce(known_label(F.col("_model.sentiment_label")), F.lit("positive"))
        model_confidence = confidence(F.col("_model.sentiment_confidence"))
    return (
        decided.withColumn("sentiment_label", F.coalesce("_given", "_rated", model_label))
        .withColumn(
            "sentiment_confidence",
            F.when(F.col("_given").isNotNull(), F.col("_given_confidence"))
            .when(F.col("_rated").isNotNull(), F.lit(1.0))
            .otherwise(model_confidence),
        )
        .withColumn(
            "sentiment_source",
            F.when(F.col("_given").isNotNull(), "precomputed").when(F.col("_rated").isNotNull(), "rating").otherwise("model"),
        )
        .drop("_given", "_given_confidence", "_rated", "_model")
    )


def distribution_columns() -> list:
    """Aggregates of one group: counts per label, total, four-decimal ratios and counts per source."""
    total = F.count(F.lit(1))
    counts = {s: F.count_if(F.col("sentiment_label") == s) for s in SENTIMENTS}
    out = [c.alias(f"{s}_count") for s, c in counts.items()]
    out.append(total.alias("total"))
    out += [
        F.when(total == 0, F.lit(0.0)).otherwise(F.round(c / total, 4)).alias(f"{s}_ratio") for s, c in counts.items()
    ]
    out += [
        F.count_if(F.col("sentiment_source") == s).alias(f"{s}_source") for s in ("precomputed", "rating", "model")
    ]
    out.append(F.lit(0).cast("bigint").alias("fallback_source"))
    return out


def distribution_counts() -> list:
    """The columns of ``distribution_columns`` that add up over parts of a group."""
    labels = [F.count_if(F.col("sentiment_label") == s).alias(f"{s}_count") for s in SENTIMENTS]
    sources = [F.count_if(F.col("sentiment_source") == s).alias(f"{s}_source") for s in ("precomputed", "rating", "model")]
    return [*labels, F.count(F.lit(1)).alias("total"), *sources, F.lit(0).cast("bigint").alias("fallback_source")]


def sentiment_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*distribution_columns())
