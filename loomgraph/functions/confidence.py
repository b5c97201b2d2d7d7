"""Wilson intervals, Bayesian confidence, time decay: column expressions.

`now` is always a parameter, so results do not depend on when they are made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Z by confidence level, clamps, decay.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
LOWEST, HIGHEST = 0.15, 0.98
LEAST_SAMPLES = 5
HALF_LIFE_DAYS, MAX_AGE_DAYS, NEGLIGIBLE = 30.0, 180.0, 0.01


def wilson(successes: Column, trials: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper bound; (0, 1) without trials."""
    z = Z.get(level, 1.96)
    n = F.when(trials > 0, trials.cast("double"))
    p = successes / n
    wide = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / wide
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / wide
    return F.coalesce(F.greatest(mid - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(mid + half, F.lit(1.0)), F.lit(1.0))


def bayes(tp: Column, fp: Column, prior: float | Column = 0.5, strength: float = 2.0) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return F.when(tp + fp == 0, prior).otherwise((tp + strength * prior) / (tp + fp + strength))


def bounds(tp: Column, fp: Column, level: float = 0.95, default: tuple[float, float] = (LOWEST, HIGHEST)) -> tuple[Column, Column]:
    """Wilson bounds of the precision, clamped and rounded; the default for few samples."""
    few = (tp + fp < LEAST_SAMPLES) | (tp + fp == 0)
    out = []
    for bound, d in zip(wilson(tp, tp + fp, level), default, strict=True):
        out.append(F.when(few, d).otherwise(F.bround(F.least(F.greatest(bound, F.lit(LOWEST)), F.lit(HIGHEST)), 4)))
    return out[0], out[1]


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, F.coalesce(low, F.lit(LOWEST))), F.coalesce(high, F.lit(HIGHEST)))


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000.0


def decay(days: Column, half_life: float = HALF_LIFE_DAYS, max_age: float = MAX_AGE_DAYS, negligible: float = NEGLIGIBLE) -> Column:
    """Half for each half-life; 1 for the future, 0 beyond max_age or below negligible."""
    factor = F.exp(-math.log(2) / half_life * days)
    return F.when(days < 0, 1.0).when(days > max_age, 0.0).when(factor < negligible, 0.0).otherwise(factor)


def relevant(days: Column, **how: float) -> Column:
    return decay(days, **how) > 0


def days_until(threshold: float, half_life: float = HALF_LIFE_DAYS) -> float:
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return -math.log(threshold) / (math.log(2) / half_life)


def weighted_confidence(events: DataFrame, key: str, days: Column, tp: Column, prior: float = 0.5, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(key, weight, confidence): decayed evidence against a prior of weight 1."""
    w = decay(days, half_life)
    return events.groupBy(key).agg(F.sum(w).alias("weight"), ((F.lit(prior) + F.sum(F.when(tp, w).otherwise(0.0))) / (F.lit(prior) + F.sum(w))).alias("confidence"))


def precision_level(precision: Column, fallback: str = "LOW") -> Column:
    return F.when(precision >= 0.9, "HIGH").when(precision >= 0.75, "MEDIUM").when(precision >= 0.5, "LOW").otherwise(fallback)


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2)))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: ece, the gap between confidence and accuracy over equal bins, by share."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    each = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))
