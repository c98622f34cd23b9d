"""Text quality by a factorisation machine over hashed words, word shapes and structure statistics."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import REMEMBERED_BYTES, bound_batches, map_texts, slices

# Buckets for words and for word shapes; statistics follow them in the feature space.
WORDS = 1 << 13
SHAPES = 1 << 12
# Labelled rows a model is fitted on, at most (those with the smallest hash of their id).
FIT_ROWS = 6_000
# Distinct words a worker remembers.
REMEMBERED = 400_000

_SHAPE = bytes.maketrans(bytes(range(256)), bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)))


def _word_code(word: bytes) -> int:
    """Word bucket and shape bucket of a word in one number. The shape keeps punctuation and collapses runs of letters and digits."""
    shape = re.sub(rb"(.)\1+", rb"\1\1", word.translate(_SHAPE), flags=re.DOTALL)
    return zlib.crc32(word.lower()) % WORDS * SHAPES + zlib.crc32(shape) % SHAPES


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        code = _word_code(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


STATISTICS = ("log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "upper", "lower", "digits", "marks", "high_bytes",
              "spaces", "log_lines", "line_words", "distinct_lines", "marks_per_word", "short_words", "shape_entropy", "top_shape")
FEATURES = WORDS + SHAPES + len(STATISTICS)
_CLASS = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 5 if b in (32, 9, 10, 11, 12, 13) else 4 if b >= 128 else 3
                   for b in range(256)], dtype=np.int64)


def features(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text: damped, length-normalised counts of hashed words and shapes, then all statistics."""
    parts = text.split()
    n = len(parts)
    codes = np.fromiter(map(words.__getitem__, parts), np.int64, n)
    by_word, by_shape = np.bincount(codes // SHAPES, minlength=0), np.bincount(codes % SHAPES, minlength=0)
    at_word, at_shape = np.flatnonzero(by_word), np.flatnonzero(by_shape)
    x_word, x_shape = np.log1p(by_word[at_word]), np.sqrt(by_shape[at_shape] / max(n, 1))
    x_word = x_word / max(np.sqrt((x_word**2).sum()), 1e-9)
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) / max(len(text), 1)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    lines = text.split(b"\n")
    share = by_shape[at_shape] / max(n, 1)
    stats = np.array([
        np.log1p(len(text)) / 10, np.log1p(n) / 10, lengths.mean() / 10 if n else 0, lengths.std() / 10 if n else 0, len(set(parts)) / max(n, 1),
        classes[0], classes[1], classes[2], classes[3], classes[4], classes[5], np.log1p(len(lines)) / 10, min(n / len(lines), 100) / 100,
        len(set(lines)) / len(lines), min(classes[3] * len(text) / max(n, 1), 5) / 5, (lengths <= 2).mean() if n else 0,
        -(share * np.log(share)).sum() / 5 if n else 0, share.max() if n else 0,
    ])
    return (np.concatenate([at_word, WORDS + at_shape, np.arange(WORDS + SHAPES, FEATURES)]), np.concatenate([x_word, x_shape, stats]))


@dataclass
class Machine:
    """bias + sum w x + 1/2 sum over factors of (sum v x)^2 - sum (v x)^2: pairwise interactions in time linear in the features."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        raw = self.bias + self.weights[at] @ x + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, rounds: int = 30, rate: float = 0.1,
        penalty: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over mini-batches of 64 in a seeded order. With no rows the bias is 0; with one class it is that class's prior."""
    rng = np.random.default_rng(seed)
    if not len(rows):
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, rank)))
    prior = (labels.sum() + 1) / (len(labels) + 2)
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, rank))
    gw, gv, gb = np.full(FEATURES, 1e-2), np.full((FEATURES, rank), 1e-2), 1e-2
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 64):
            chosen = order[start:start + 64]
            at = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen])
            sizes = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[at] * x[:, None]
            summed = np.add.reduceat(vx, starts)
            raw = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * ((summed**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            off = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[chosen]
            per = np.repeat(off, sizes) / len(chosen)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, per * x) + penalty * w[used]
            inner = per[:, None] * x[:, None] * (np.repeat(summed, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(back, inner[:, f]) for f in range(rank)], 1) + penalty * v[used]
            db = off.mean()
            gb += db**2
            gw[used] += dw**2
            gv[used] += dv**2
            bias -= rate * db / np.sqrt(gb)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(float(bias), w, v)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out fold (crc32 of the id as text, mod 5, is 0).

    Rows with a null id or label are left out; a document labelled twice counts once; of rows that share an id one is learned, that with the
    smallest hash of its text. Only the text gives features.
    """
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out_fold()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("_hash", F.xxhash64("text"))
    one = texts.select("doc_id", "_hash").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("_hash").alias("_hash"))
    texts = texts.join(F.broadcast(one), ["doc_id", "_hash"]).select("doc_id", "text", "_label")

    def run(batches):
        words, seen = Words(), set()
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            part = part.take(pa.array(new, pa.int64()))
            found = [features(t, words) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label").cast(pa.int32()), pa.array([a.astype(np.int32).tobytes() for a, _ in found]),
                                              pa.array([x.astype(np.float32).tobytes() for _, x in found])], ["doc_id", "label", "at", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"doc_id {id_type}, label int, at binary, x binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(np.float64)) for a, x in zip(found["at"].to_pylist(), found["x"].to_pylist())]
    return fit(rows, found["label"].to_numpy().astype(np.float64))


def held_out_fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 when score >= ``threshold``).

    A null text is scored as an empty one; a null doc_id stays null; repeated rows get equal scores; an empty table gives no
    rows. Only the text is an input of the score; other columns are not read. The machine has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        words, model = Words(), shared.value

        def columns(texts: list[bytes]) -> dict:
            scores = [model.score(*features(t, words)) for t in texts]
            return {"score": scores, "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}

        return columns

    return map_texts(docs, "doc_id", "text", "score double, predicted int", make)


def keep_quality(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores below ``threshold``. No shuffle; columns may have any names."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches):
        words, model = Words(), shared.value
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            yield part.filter(pa.array([model.score(*features((t or "").encode(), words)) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
