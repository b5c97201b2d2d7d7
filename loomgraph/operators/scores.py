"""Windows over score histories: anomalies, tiers, trends, order of steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIER_ORDER = ("exploratory", "standard", "important", "core")


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key: a bounded top-k within the key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def anomalies(scores: DataFrame, key: str, order: str, score: str, n: int = 20, least: int = 3, ceiling: float = 95, floor: float = 10) -> DataFrame:
    """CEILING, FLOOR or ZERO_VARIANCE of the last n scores, in this order of tests."""
    low, high = F.min(score), F.max(score)
    kind = F.when(low >= ceiling, "CEILING").when(high <= floor, "FLOOR").when(low == high, "ZERO_VARIANCE")
    return last_n(scores, key, order, n).groupBy(key).agg(F.count("*").alias("n"), kind.alias("anomaly")).where((F.col("n") >= least) & F.col("anomaly").isNotNull())


def tier_moves(scores: DataFrame, tiers: DataFrame, key: str, order: str, score: str, n: int = 5, low: float = 50, high: float = 90) -> DataFrame:
    """Up one tier (auto) if the last n scores are all below low, down (manual) if all are above high."""
    s = last_n(scores, key, order, n).groupBy(key).agg(F.count("*").alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).where(F.col("n") == n)
    names = F.array(*map(F.lit, TIER_ORDER))
    at = F.greatest(F.array_position(names, F.col("tier")) - 1, F.lit(0))
    out = s.join(tiers, key).withColumn("at", at.cast("int"))
    move = F.when((F.col("hi") < low) & (F.col("at") < len(TIER_ORDER) - 1), 1).when((F.col("lo") > high) & (F.col("at") > 0), -1)
    return out.withColumn("move", move).where("move is not null").select(key, "tier", F.element_at(names, F.col("at") + F.col("move") + 1).alias("new_tier"), F.when(F.col("move") > 0, "auto").otherwise("manual").alias("how"))


def trend(points: DataFrame, key: str, ts: str, value: str, since, most: int | None = None) -> DataFrame:
    rows = points.where(F.col(ts) >= since)
    return (last_n(rows, key, ts, most) if most else rows).select(key, ts, value)


def before(rows: DataFrame, key: str, order: str, kind: str, first: str, second: str) -> DataFrame:
    """Whether each key's first `first` row comes before its first `second` row; null without both."""
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(order)))
    return rows.groupBy(key).agg((at(first) < at(second)).alias("in_order"))


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average at each key's last row. Weights fall by 1 - alpha a
    row, so only the last rows, until they are below a double's last digit, count;
    the first row of a shorter history weighs what is left."""
    n = max(1, math.ceil(math.log(1e-17) / math.log(1 - alpha))) if alpha < 1 else 1
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = rows.select(key, F.col(value).cast("double").alias("v"), F.row_number().over(w).alias("r")).where(F.col("r") <= n)
    first = F.max(F.struct("r", "v"))
    fall = lambda r: F.pow(F.lit(1 - alpha), r - 1)
    return last.groupBy(key).agg((F.sum(F.col("v") * alpha * fall(F.col("r"))) + first["v"] * (1 - alpha) * fall(first["r"])).alias("ema"))
