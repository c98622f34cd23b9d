"""Text and vector overlap of one pair, as Arrow functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfsense.schemas import struct_of

_SCORES = struct_of("precision double, recall double, f1 double")
# Rows of a similarity block of ``soft_alignment``.
_BLOCK = 1_024

# ROUGE tokens and the suffix rules of Porter's algorithm (1980), each step tried in order.
ROUGE_TOKEN = "[a-z0-9]+"
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
    "ive", "ize",
)


# Irregular words of the extended stemmer.
IRREGULAR = {
    "sky": ("sky", "skies"), "die": ("dying",), "lie": ("lying",), "tie": ("tying",), "news": ("news",), "inning": ("innings", "inning"),
    "outing": ("outings", "outing"), "canning": ("cannings", "canning"), "howe": ("howe",), "proceed": ("proceed",), "exceed": ("exceed",),
    "succeed": ("succeed",),
}
_STEM_OF = {form: stem for stem, forms in IRREGULAR.items() for form in forms}


def _shape(stem: str) -> str:
    """v and c per letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_short(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or just vowel and consonant."""
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _longer_suffixes(word: str) -> str:
    """The second step. ``alli`` becomes ``al`` and the step goes on; the measure of ``logi`` counts its l."""
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _longer_suffixes(word[:-2])
    for suffix, to in sorted((*STEP2, ("fulli", "ful")), key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if _measure(word[:-3] if suffix == "logi" else stem) > 0 else word
    return word


def porter_stem(word: str) -> str:
    """Porter's suffix stripping with the usual extensions: irregular words, four-letter words in -ies and -ied, and y only
    after a consonant that does not begin the word."""
    if word in _STEM_OF:
        return _STEM_OF[word]
    if len(word) <= 2:
        return word
    # plurals
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + ("ie" if suffix == "ies" and len(word) == 4 else to)
            break
    # past and progressive
    if word.endswith("ied"):
        word = word[:-3] + ("ie" if len(word) == 4 else "i")
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            stem = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_short(word):
                    word += "e"
                break
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _longer_suffixes(word)
    for suffix, to in sorted(STEP3, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > 0:
                word = stem + to
            break
    for suffix in sorted(STEP4, key=lambda s: -len(s)):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def rouge_tokens(text: str | None, stems: dict[str, str]) -> list[str]:
    out = []
    for token in re.findall(ROUGE_TOKEN, (text or "").lower()):
        if len(token) > 3:
            if token not in stems:
                stems[token] = porter_stem(token)
            token = stems[token]
        out.append(token)
    return out


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence with one bit per token of ``a`` (Hyyrö's bit-vector recurrence)."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        match = row & places.get(token, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


# A worker's stems, each word's found once; started afresh when full.
_STEMS: dict[str, str] = {}


@F.pandas_udf(_SCORES)
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """ROUGE-L over stemmed tokens of the whole texts."""
    stems = _STEMS
    if len(stems) > 500_000:
        stems.clear()
    rows = []
    for ref, cand in zip(reference, candidate):
        r, c = rouge_tokens(ref, stems), rouge_tokens(cand, stems)
        common = lcs_length(r, c) if r and c else 0
        p, q = (common / len(c), common / len(r)) if common else (0.0, 0.0)
        rows.append((p, q, 2 * p * q / (p + q) if common else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


def _matrix(vectors, width: int) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, width))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


@F.pandas_udf(_SCORES)
def soft_alignment(reference: pd.Series, reference_counts: pd.Series, candidate: pd.Series, candidate_counts: pd.Series) -> pd.DataFrame:
    """Greedy matching by cosine: every candidate token meets its best reference token and the other way round.

    Tokens come as distinct vectors with their number of occurrences.
    """
    rows = []
    for rv, rc, cv, cc in zip(reference, reference_counts, candidate, candidate_counts):
        if rv is None or cv is None or len(rv) == 0 or len(cv) == 0:
            rows.append((0.0, 0.0, 0.0))
            continue
        # block by block with running maxima, so that long texts need no full matrix
        left, right = _matrix(cv, len(rv[0])), _matrix(rv, len(rv[0]))
        best_left, best_right = [], np.full(len(right), -np.inf)
        for start in range(0, len(left), _BLOCK):
            own = np.full(len(left[start:start + _BLOCK]), -np.inf)
            for other in range(0, len(right), _BLOCK):
                sims = left[start:start + _BLOCK] @ right[other:other + _BLOCK].T
                own = np.maximum(own, sims.max(axis=1))
                best_right[other:other + _BLOCK] = np.maximum(best_right[other:other + _BLOCK], sims.max(axis=0))
            best_left.append(own)
        p = float(np.average(np.concatenate(best_left), weights=np.asarray(cc, dtype=np.float64)))
        r = float(np.average(best_right, weights=np.asarray(rc, dtype=np.float64)))
        rows.append((p, r, 2 * p * r / (p + r) if p + r != 0 else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])
