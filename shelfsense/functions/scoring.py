"""Scores and labels of one review as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.coerce import parse_number
from shelfsense.functions.text import null_to_blank
from shelfsense.schemas import SENTIMENTS

# Weights of helpfulness, verification and length, and the ideal length band in tokens.
WEIGHTS = (0.40, 0.30, 0.30)
IDEAL_MIN, IDEAL_MAX, HARD_MAX = 20, 100, 300
LENGTH_FLOOR = 0.2


def length_score(tokens: Column, ideal_min: int = IDEAL_MIN, ideal_max: int = IDEAL_MAX,
                 hard_max: int = HARD_MAX) -> Column:
    """0 for nothing, rising to 1 at the ideal band, falling past it, never below the floor."""
    falling = F.lit(1.0) - (tokens - ideal_max) / F.lit(float(hard_max - ideal_max))
    return (
        F.when(tokens <= 0, F.lit(0.0))
        .when(tokens < ideal_min, tokens / F.lit(float(ideal_min)))
        .when(tokens <= ideal_max, F.lit(1.0))
        .when(tokens >= hard_max, F.lit(LENGTH_FLOOR))
        .otherwise(F.greatest(F.lit(LENGTH_FLOOR), falling))
    )


@F.pandas_udf(T.DoubleType())
def _log(values: pd.Series) -> pd.Series:
    """The C library's logarithm, computed once per distinct value of a batch."""
    seen, at = np.unique(values.to_numpy(), return_inverse=True)
    return pd.Series(np.array([math.log(v) for v in seen.tolist()], dtype=np.float64)[at])


def vote_log(votes: Column) -> Column:
    """log(1 + votes), missing and negative votes counting as none.

    The JVM's logarithms miss the nearest double for some counts (2, 13 and 47 with log1p). Scores that agree but for that bit would then stand in
    another order than in engines that use the C library.
    """
    return _log(F.lit(1.0) + F.greatest(F.coalesce(votes.cast("double"), F.lit(0.0)), F.lit(0.0)))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0..1 within the given range; 0 where the range is empty or unknown."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def quality(votes_norm: Column, verified: Column, length: Column, weights=WEIGHTS) -> Column:
    helpful, proof, size = (F.lit(float(w)) for w in weights)
    total = F.lit(float(weights[0] + weights[1] + weights[2]))
    return (helpful * votes_norm + proof * F.coalesce(verified.cast("double"), F.lit(0.0)) + size * length) / total


def training_label(rating: Column) -> Column:
    """Label of the training data: 4 and up, exactly 3, everything else negative."""
    return F.when(rating >= 4, "positive").when(rating == 3, "neutral").otherwise("negative")


def rating_label(rating: Column) -> Column:
    """Label used when serving: only clear ratings decide, 2 < r < 4 other than 3 stays open."""
    value = F.nanvl(rating.cast("double"), F.lit(None).cast("double"))
    return F.when(value >= 4, "positive").when(value == 3, "neutral").when(value <= 2, "negative")


def known_label(value: Column) -> Column:
    """A label of the fixed set, case and surrounding space ignored, else NULL."""
    label = F.lower(null_to_blank(value))
    return F.when(label.isin(*SENTIMENTS), label)


def confidence(value: Column, default: float = 1.0) -> Column:
    number = F.coalesce(parse_number(value), F.lit(float(default)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
