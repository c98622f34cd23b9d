"""Secret scans: broad candidates, then a random forest removes false positives."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import saved, slices

# Labelled findings of each class that the forest is fitted on, at most (those with the smallest hash of document and place).
FIT_ROWS = 10_000
# Names that credentials are assigned to, and what stands in for one in examples.
NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "auth", "credential", "bearer", "private")
STAND_INS = ("example", "changeme", "placeholder", "dummy", "xxxx", "your_", "sample", "test")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.\-]{16,}")
_NAMED = re.compile(rb"(?:" + b"|".join(n.encode() for n in NAMES) + rb")[\"']?\s*(?::=|[:=]>?)\s*[\"']?\Z", re.IGNORECASE)
# Forms by which vendors' keys and tokens are known wherever they stand.
FORMS = re.compile(rb"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{20}|"
                   rb"xox[abeoprs]-[A-Za-z0-9\-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|"
                   rb"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*)")
# Values of any characters and from 6 on that a credential's name is assigned or that follow the user in a URL.
_VALUE = re.compile(_NAMED.pattern.removesuffix(rb"[\"']?\Z") + rb"(?:\"(?P<double>[^\"\r\n]{6,})\"|'(?P<single>[^'\r\n]{6,})'|[\"']?(?P<bare>[^\s\"'=][^\s\"']{5,}))"
                    rb"|://[^\s/:@]*:(?P<url>[^\s/@]{6,}(?:@[^\s/@]+)*)@", re.IGNORECASE)
_WORD = re.compile(rb"[A-Za-z_]+")
FEATURES = ("length", "transitions", "transition_share", "entropy", "digits", "upper", "lower", "marks", "hex", "distinct", "longest_letters",
            "longest_digits", "dictionary", "slashes", "dots", "path_before", "name_before", "name_near", "stand_in", "quoted", "assigned")
# Those of the bytes around a candidate.
SURROUNDINGS = ("path_before", "name_before", "name_near", "quoted", "assigned")
# Bytes of context read on each side of a candidate.
AROUND = 60


def dictionary(path: str, shortest: int = 4) -> frozenset[bytes]:
    """Lower-case letter strings of a public vocabulary file, as words and word parts."""
    with open(path, encoding="utf-8") as f:
        strings = json.load(f)["model"]["vocab"]
    return frozenset(w.encode() for s in strings if (w := s.lstrip("Ġ").lower()).isascii() and w.isalpha() and shortest <= len(w) <= 16)


def coverage(value: bytes, words: frozenset[bytes]) -> float:
    """Share of the value's bytes that the longest dictionary words from left to right cover."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        size = next((n for n in range(min(16, len(low) - at), 3, -1) if low[at:at + n] in words), 0)
        covered += size
        at += size or 1
    return covered / len(low)


def _class(b: int) -> int:
    return 0 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3


def describe(value: bytes, before: bytes, after: bytes, words: frozenset[bytes]) -> list[float]:
    """The features of a candidate from itself and the bytes around it."""
    n, kinds = len(value), [_class(b) for b in value]
    counts, by_kind = Counter(value), Counter(kinds)
    moves = sum(a != b for a, b in zip(kinds, kinds[1:]))
    near = [w.lower() for w in _WORD.findall(before)[-3:] + _WORD.findall(after)[:3]]
    low = value.lower()
    tail = before.rstrip()
    return [
        min(n, 512), min(moves, 512), moves / n, -sum(c / n * math.log2(c / n) for c in counts.values()), by_kind[0] / n, by_kind[1] / n, by_kind[2] / n,
        by_kind[3] / n, sum(c for b, c in counts.items() if b in b"0123456789abcdefABCDEF") / n, len(counts) / n,
        max(map(len, re.findall(rb"[A-Za-z]+", value)), default=0), max(map(len, re.findall(rb"[0-9]+", value)), default=0), coverage(value, words),
        value.count(b"/"), value.count(b"."), float(before[-1:] in (b"/", b"\\", b":", b"@")), float(bool(near and tail) and any(near[0:3][-1].endswith(x.encode()) for x in NAMES)),
        float(sum(any(x.encode() in w for x in NAMES) for w in near)), float(any(x.encode() in low for x in STAND_INS)),
        float(before[-1:] in (b'"', b"'", b"`") and after[:1] in (b'"', b"'", b"`")), float(tail.rstrip(b"\"'`").rstrip()[-1:] in (b"=", b":")),
    ]


def spans(raw: bytes) -> list[tuple[int, int, bool]]:
    """Start, end and whether a credential's name is assigned it (or a user of a URL goes before) of each candidate, by place: runs of
    ``CANDIDATE``, and named values, which may lie in such a run or hold several."""
    found = {m.span(): bool(_NAMED.search(raw, max(0, m.start() - AROUND), m.start())) for m in CANDIDATE.finditer(raw)}
    at = 0
    while m := _VALUE.search(raw, at):
        start, end = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            end = start + len(raw[start:end].rstrip(b".,;:)]}>"))
        if end - start >= 6:
            found[start, end] = True
        at = start if end - start <= 512 else end  # a value may hold a name and a value of its own
    return [(*span, named) for span, named in sorted(found.items())]


def candidates(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate of each whole text: doc_id, at (its first byte), length, named (a credential's name is assigned it), form (it has
    a vendor's known form), features. Candidates may overlap."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        words = shared.value
        for part in slices(batches):
            rows, at, length, named, form, found = [], [], [], [], [], []
            for i, raw in enumerate(part.column(1).to_pylist()):
                for start, end, assigned in spans(raw):
                    value, before, after = raw[start:end], raw[max(0, start - AROUND):start], raw[end:end + AROUND]
                    rows.append(i)
                    at.append(start)
                    length.append(end - start)
                    named.append(assigned)
                    form.append(bool(FORMS.search(value)))
                    found.append(describe(value, before, after, words))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()), pa.array(length, pa.int64()),
                                              pa.array(named, pa.bool_()), pa.array(form, pa.bool_()), pa.array(found, pa.list_(pa.float32()))],
                                             ["doc_id", "at", "length", "named", "form", "features"])

    return narrow.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, at long, length long, named boolean, form boolean, features array<float>")


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings (doc_id, at, length, label) where no reviewer's are at hand: 1 for a random-looking value that a credential's name is
    assigned or that has a vendor's known form; 0 for an unnamed one that reads as words, a path, a number or a stand-in. Named values that
    read so stay unlabelled, and unnamed random-looking ones too, as a secret may stand bare."""
    feature = {name: F.element_at("features", i + 1) for i, name in enumerate(FEATURES)}
    random_looking = (feature["entropy"] >= 2.5) & (feature["dictionary"] < 0.6) & (feature["stand_in"] == 0) & (feature["digits"] > 0)
    number = (feature["upper"] == 0) & (feature["lower"] == 0)
    path = (feature["slashes"] > 0) & (feature["dictionary"] >= 0.3)
    word = (feature["dictionary"] >= 0.6) | (feature["digits"] == 0) & (feature["transition_share"] <= 0.2)
    reads = number | path | word | (feature["entropy"] < 2.5) | (feature["stand_in"] > 0)
    secret = (F.col("form") & (feature["stand_in"] == 0)) | (F.col("named") & random_looking)
    return found.select("doc_id", "at", "length", F.when(secret, 1.0).when(~F.col("named") & reads, 0.0).alias("label")).where("label IS NOT NULL")


def fit_forest(found: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 30, depth: int = 6, seed: int = 5,
               bare: bool = False) -> RandomForestClassificationModel | None:
    """A forest over the features of labelled candidates (doc_id, at, label 0/1, and length where candidates of one place differ); null ids are
    left out. None where a class is missing. With ``bare`` each secret is learned a second time without its surroundings, for labels that
    come from these."""
    on = ["doc_id", "at", *(["length"] if "length" in labelled.columns else [])]
    rows = found.where("doc_id IS NOT NULL").join(labelled.where("label IN (0, 1)").dropDuplicates(on), on)
    order = [F.xxhash64("doc_id", "at"), F.col("doc_id"), F.col("at"), F.col("length")]
    narrow = rows.select("doc_id", "at", "length", "label", "features")
    each = [narrow.where(F.col("label") == c).orderBy(*order).limit(fit_rows) for c in (0.0, 1.0)]
    if bare:
        around = [i for i, name in enumerate(FEATURES) if name in SURROUNDINGS]
        each.append(each[1].withColumn("features", F.transform("features", lambda x, i: F.when(i.isin(around), 0.0).otherwise(x).cast("float"))))
    sample = saved(reduce(DataFrame.unionByName, each).select("label", array_to_vector(F.col("features").cast("array<double>")).alias("features")), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(sample)


def judge(found: DataFrame, forest: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """Each candidate with score (0 to 1) and secret (score >= ``threshold``): doc_id, at, length, score, secret.

    Without a forest (no labelled findings of both classes) a candidate scores 1 when a credential's name is assigned it or it has a vendor's form, else 0. Texts of any
    length are scanned whole; a null or empty text has no candidates; a null doc_id stays null; repeated rows repeat theirs; an empty table
    gives no rows; other columns are not read.
    """
    if forest is None:
        scored = found.withColumn("score", (F.col("named") | F.col("form")).cast("double"))
    else:
        vectors = found.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
        scored = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "at", "length", "score", (F.col("score") >= threshold).alias("secret"))


def scan(docs: DataFrame, vocabulary: str, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Candidates of ``docs`` judged by a forest that is fitted on ``labelled`` findings (doc_id, at, label), by default ``weak_labels`` of the
    documents whose id's crc32 mod 5 is not 0, whose secrets it also learns bare. The candidates are written once and read by both passes."""
    found, bare = saved(candidates(docs, vocabulary), "candidates"), labelled is None
    if bare:
        labelled = weak_labels(found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return judge(found, fit_forest(found, labelled, fit_rows, bare=bare), threshold)
