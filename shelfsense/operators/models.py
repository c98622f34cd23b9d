"""Trained models: review sentiment and text language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, IndexToString, Normalizer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.text import strip
from shelfsense.operators.evaluation import with_class_weights
from shelfsense.operators.features import MAX_TERMS, MIN_DF, vocabulary, with_terms
from shelfsense.schemas import MODEL_LABELS, struct_of

# The languages the filter tells apart.
LANGUAGES = ("en", "es", "fr", "de", "it", "pt")


def model_rows(df: DataFrame, text: str = "text", label: str = "sentiment_label", labels=MODEL_LABELS) -> DataFrame:
    """Rows with text and a known label."""
    return df.where((strip(F.coalesce(F.col(text), F.lit(""))) != "") & F.col(label).isin(*labels))


def train_sentiment(df: DataFrame, text: str = "text", label: str = "sentiment_label", c: float = 1.0, max_iter: int = 1000,
                    min_df: int = MIN_DF, max_terms: int = MAX_TERMS, labels=MODEL_LABELS) -> PipelineModel:
    """TF-IDF over words and bigrams, then multinomial logistic regression with balanced class weights.

    The penalty equals that of a summed loss with inverse strength ``c``; only the vocabulary (at most
    ``max_terms``) and the coefficients come to the driver.
    """
    rows = with_terms(with_class_weights(model_rows(df, text, label, labels), label, labels), text)
    known = vocabulary(model_rows(df, text, label, labels).withColumn("_row", F.lit(0)), "_row", text, min_df, max_terms)
    terms = [r["term"] for r in known.select("term").collect()]  # at most max_terms
    if not terms:
        raise ValueError(f"no training rows with text and a label among {', '.join(labels)}, or no term in {min_df} of them")
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_tf")
    # Read by each pass before the regression, which keeps blocks of its own: only counts by number are held, and on disk, so that memory is left for the blocks.
    counted = counter.transform(rows.select("terms", label, "class_weight")).drop("terms").persist(StorageLevel.DISK_ONLY)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_scaled")
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="features")
    indexer = StringIndexerModel.from_labels(list(labels), inputCol=label, outputCol="_label", handleInvalid="skip")
    ready = indexer.transform(unit.transform(scale.transform(counted)))
    total = ready.agg(F.sum("class_weight")).first()[0]
    regression = LogisticRegression(
        featuresCol="features", labelCol="_label", weightCol="class_weight", family="multinomial", maxIter=max_iter,
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
    ).fit(ready)
    counted.unpersist()
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(labels))
    return PipelineModel(stages=[counter, scale, unit, regression, names])


def predict_sentiment(model: PipelineModel, df: DataFrame, text: str = "text", labels=MODEL_LABELS) -> DataFrame:
    """Label, highest probability and one probability column per label."""
    scored = model.transform(with_terms(df, text)).withColumn("_p", vector_to_array("probability"))
    return scored.select(
        *df.columns, "predicted_label", F.array_max("_p").alias("confidence"),
        *[F.col("_p")[i].alias(f"prob_{x}") for i, x in enumerate(labels)],
    )


@dataclass(frozen=True)
class LanguageModel:
    """Naive Bayes over hashed character groups: a table of languages x buckets, whatever it was learnt from."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray  # log probability per bucket and language


def gram_buckets(text: str, dims: int) -> np.ndarray:
    """Buckets of all single characters, pairs and triples of the whole lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    mixed = [c * np.uint64(0x9E3779B1)]
    if len(c) > 1:
        mixed.append((c[:-1] << np.uint64(21) | c[1:]) * np.uint64(0x85EBCA77))
    if len(c) > 2:
        mixed.append((c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) * np.uint64(0xC2B2AE3D))
    return ((np.concatenate(mixed) >> np.uint64(17)) % np.uint64(dims)).astype(np.int64)


def train_language(df: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1 << 14, languages=LANGUAGES) -> LanguageModel:
    """Learn from labelled texts. Tasks reduce their texts to bucket counts; at most languages x (dims + 1) sums reach
    the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"]):
                if name not in sums:
                    sums[name], rows[name] = np.zeros(dims, dtype=np.int64), 0
                sums[name] += np.bincount(gram_buckets(body, dims), minlength=dims)
                rows[name] += 1
        for name, total in sums.items():
            at = np.flatnonzero(total)
            # bucket -1 carries the number of texts
            yield pd.DataFrame({"lang": name, "bucket": np.append(at, -1), "n": np.append(total[at], rows[name])})

    known = df.where(F.col(lang).isin(*languages) & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInPandas(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = counts.toPandas()
    seen = tuple(sorted(cells["lang"].unique()))
    table = np.ones((len(seen), dims))
    prior = np.zeros(len(seen))
    for i, name in enumerate(seen):
        own = cells[cells["lang"] == name]
        grams = own[own["bucket"] >= 0]
        table[i, grams["bucket"].to_numpy()] += grams["n"].to_numpy()
        prior[i] = own.loc[own["bucket"] < 0, "n"].sum()
    return LanguageModel(seen, np.log(prior / prior.sum()), np.log(table / table.sum(axis=1, keepdims=True)))


def detect_language(model: LanguageModel, df: DataFrame, text: str = "text") -> DataFrame:
    """``detected_lang`` with its probability ``lang_conf``; blank text is unknown with 0."""

    @F.pandas_udf(struct_of("detected_lang string, lang_conf double"))
    def classify(texts: pd.Series) -> pd.DataFrame:
        out = []
        for body in texts:
            if body is None or not body.strip():
                out.append(("unknown", 0.0))
                continue
            scores = model.prior + model.weights[:, gram_buckets(body, model.weights.shape[1])].sum(axis=1)
            odds = np.exp(scores - scores.max())
            best = int(odds.argmax())
            out.append((model.languages[best], float(odds[best] / odds.sum())))
        return pd.DataFrame(out, columns=["detected_lang", "lang_conf"])

    return df.withColumn("_lang", classify(F.col(text))).select(*df.columns, "_lang.*")


def detect_language_across(df: DataFrame, row_id: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """``detect_language`` for labelled rows, each by a model that was trained on the other half of the ids."""
    half = F.crc32(F.col(row_id).cast("string").cast("binary")) % 2
    parts = [detect_language(train_language(df.where(half != i), text, lang), df.where(half == i), text) for i in (0, 1)]
    return parts[0].unionByName(parts[1])
