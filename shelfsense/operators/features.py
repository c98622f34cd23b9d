"""Word features: unigrams and bigrams, vocabulary, TF-IDF, hashed vectors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsense.functions.text import is_ascii
from shelfsense.session import ensure_checkpoint_dir

# Token pattern and vocabulary limits of the baseline model.
TOKEN = r"\w{2,}"
MIN_DF = 2
MAX_TERMS = 30_000
# Rows whose terms are counted at a time.
TERM_ROWS = 1_024


def words(text: Column) -> Column:
    """Runs of at least two word characters of any script, in order; case is kept. ASCII text takes the faster class."""
    return F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit("(?U)" + TOKEN), F.lit(0))
    )


def neighbours(items: Column, sep: str = "", n: int = 2) -> Column:
    """Every run of ``n`` neighbouring items joined by ``sep``. Shifted slices are zipped: looking items up by place in
    a lambda would evaluate the array again for every item."""
    out = F.slice(items, F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(0)))
    for k in range(1, n):
        shifted = F.slice(items, F.lit(k + 1), F.greatest(F.size(items) - (n - 1), F.lit(0)))
        out = F.zip_with(out, shifted, lambda a, b: F.concat(a, F.lit(sep), b))
    return out


def with_terms(df: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """Unigrams followed by bigrams as an array column."""
    tokens = df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    return tokens.withColumn(out, F.concat("_words", neighbours(F.col("_words"), " "))).drop("_words")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _row_terms(words: list[str]) -> Counter:
    """Unigrams and bigrams of one row with their counts."""
    counts = Counter(words)
    counts.update(map(" ".join, zip(words, words[1:])))
    return counts


def _counted(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of each pair of a row and a code below ``size``."""
    pairs, n = np.unique(rows * size + codes, return_counts=True)
    return pairs // size, pairs % size, n


def _numbered_terms(words: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Unigrams, then bigrams, of many rows: for each (row, term) a place in the distinct terms, these terms, and the occurrences; rows come
    last. Words are numbered once, pairs of them by their numbers, and only distinct pairs become strings."""
    coded = words.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
    row, at, n = _counted(rows, codes, max(len(names), 1))
    yield at, names, n, row
    near = rows[1:] == rows[:-1]
    pairs, numbered = np.unique(codes[:-1][near] * len(names) + codes[1:][near], return_inverse=True)
    row, at, n = _counted(rows[1:][near], numbered, max(len(pairs), 1))
    first, second = np.divmod(pairs, max(len(names), 1))
    yield at, pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " "), n, row


def _words_only(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.select(F.col(row_id).alias("row_id"), words(F.coalesce(F.col(text), F.lit(""))).alias("words"))


def term_counts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Occurrences per row and term. A row's words sit in the row, so they are counted there: no exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            counted = [_row_terms(w) for w in part.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(rows)), pa.array([t for c in counted for t in c], pa.string()),
                pa.array([n for c in counted for n in c.values()], pa.int64()),
            ], [row_id, "term", "tf"])

    return _words_only(df, row_id, text).mapInArrow(count, f"{row_id} {df.schema[row_id].dataType.simpleString()}, term string, tf long")


def document_frequency(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Per term: rows that contain it and occurrences overall. Each slice of rows gives its own counts, which tasks add up before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, TERM_ROWS):
            for at, terms, tfs, _ in _numbered_terms(part.column(0)):
                n = len(terms)
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(at, minlength=n)), pa.array(np.bincount(at, tfs, n).astype(np.int64))], ["term", "df", "total_tf"])

    partial = _words_only(df, row_id, text).select("words").mapInArrow(count, "term string, df long, total_tf long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def vocabulary(df: DataFrame, row_id: str, text: str, min_df: int = MIN_DF, size: int = MAX_TERMS) -> DataFrame:
    """The ``size`` most frequent terms in at least ``min_df`` rows, ties in term order.

    Counts are binned on a scale of one per cent (a few thousand bins at most); only terms of the bins that reach ``size`` are sorted, so
    the one task that ends the sort sees little more than ``size`` terms however many tasks there are. The counts are kept in the shared folder:
    bins and terms are two passes over them, the texts are counted once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = document_frequency(df, row_id, text).where(F.col("df") >= min_df).checkpoint()
    bin_ = F.floor(F.log("total_tf") * 100)
    above = W.orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)
    bins = kept.groupBy(bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    lowest = bins.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).where(F.col("_above") < size).agg(F.min("_bin"))
    return kept.withColumn("_lowest", lowest.scalar()).where(bin_ >= F.col("_lowest")).drop("_lowest").orderBy(F.desc("total_tf"), "term").limit(size)


def tfidf(df: DataFrame, row_id: str, text: str, min_df: int = MIN_DF, size: int = MAX_TERMS) -> DataFrame:
    """Smoothed TF-IDF weights of each row's vocabulary terms, each row of unit length.

    The vocabulary is at most ``size`` terms; it comes to the driver and goes to every task. Counting, weighting and scaling happen
    inside the row, so the texts are not exchanged.
    """
    rows = df.count()
    found = vocabulary(df, row_id, text, min_df, size).select("term", "df").collect()
    known = df.sparkSession.sparkContext.broadcast(([r["term"] for r in found], [math.log((1.0 + rows) / (1.0 + r["df"])) + 1.0 for r in found]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = pa.array(known.value[0], pa.string()), np.array(known.value[1])
        for part in _slices(batches, TERM_ROWS):
            kept = []
            for at, terms, tfs, row in _numbered_terms(part.column(1)):
                place = pc.index_in(terms, value_set=names).fill_null(-1).to_numpy()[at]
                kept.append((row[place >= 0], place[place >= 0], tfs[place >= 0]))
            row, place, tfs = (np.concatenate(c).astype(np.int64) for c in zip(*kept))
            raw = tfs * idf[place]
            length = np.sqrt(np.bincount(row, raw * raw, part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), names.take(pa.array(place)), pa.array(tfs), pa.array(raw / length[row])],
                                             [row_id, "term", "tf", "weight"])

    kind = df.schema[row_id].dataType.simpleString()
    return _words_only(df, row_id, text).mapInArrow(weigh, f"{row_id} {kind}, term string, tf long, weight double")


def hashed_vectors(df: DataFrame, text: str, out: str = "vector", dims: int = 256) -> DataFrame:
    """Unit-length hashed word counts as an array: the built-in stand-in for a sentence encoder."""
    split = df.withColumn("_words", words(F.lower(F.coalesce(F.col(text), F.lit("")))))
    hashed = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_tf").transform(split)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")
