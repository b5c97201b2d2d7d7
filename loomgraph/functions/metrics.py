"""Quality metrics: definitions, status, and the eight indicators over events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    target: float
    warning: float
    critical: float
    unit: str
    higher_is_better: bool
    needs: tuple[str, ...] = ()


WORK, MODEL = "work items", "model"
# Targets and thresholds of the metrics, and what must be there to measure them.
METRICS = (
    Metric("detection_rate", 0.80, 0.75, 0.70, "percentage", True),
    Metric("false_positive_rate", 0.15, 0.18, 0.20, "percentage", False),
    Metric("pattern_precision", 0.85, 0.80, 0.75, "percentage", True),
    Metric("scaffold_compile_rate", 0.60, 0.50, 0.40, "percentage", True, (WORK,)),
    Metric("llm_autonomy", 0.70, 0.60, 0.50, "percentage", True, (WORK, MODEL)),
    Metric("time_to_detection", 30.0, 45.0, 60.0, "seconds", False),
    Metric("token_efficiency", 10000.0, 15000.0, 20000.0, "tokens", False, (MODEL,)),
    Metric("escalation_rate", 0.20, 0.25, 0.30, "percentage", False, (WORK,)),
)
STATUSES = ("ok", "warning", "critical")


def definitions(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.target, m.warning, m.critical, m.unit, m.higher_is_better, list(m.needs)) for m in METRICS]
    return spark.createDataFrame(rows, "metric string, target double, warning double, critical double, unit string, higher_is_better boolean, needs array<string>")


def available(defs: DataFrame, done: list[str]) -> DataFrame:
    have = F.array(*map(F.lit, done)) if done else F.array().cast("array<string>")
    return defs.where(F.size(F.array_except("needs", have)) == 0)


def group(kind: str) -> list[str]:
    """Names of core metrics, or of those that need work items or a model (the latter first)."""
    of = {"core": lambda m: not m.needs, "model": lambda m: MODEL in m.needs, "work": lambda m: m.needs == (WORK,)}[kind]
    return [m.name for m in METRICS if of(m)]


def status(value: Column, target: Column, warning: Column, higher_is_better: Column) -> Column:
    """ok, warning or critical; the critical threshold itself is not consulted."""
    up = F.when(value >= target, "ok").when(value >= warning, "warning").otherwise("critical")
    down = F.when(value <= target, "ok").when(value <= warning, "warning").otherwise("critical")
    return F.when(higher_is_better, up).otherwise(down)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


def outcome(expected: Column, detected: Column) -> Column:
    return F.when(expected & detected, "TP").when(detected, "FP").when(expected, "FN").otherwise("TN")


def detection_indicators(events: DataFrame) -> DataFrame:
    """One row: detection_rate, false_positive_rate and pattern_precision (the mean over patterns)."""
    tp, fp = F.count_if(F.col("expected") & F.col("detected")), F.count_if(~F.col("expected") & F.col("detected"))
    each = events.groupBy("pattern_id").agg(tp.alias("tp"), fp.alias("fp"), F.count_if("expected").alias("expected"))
    return each.agg(
        ratio(F.sum("tp"), F.sum("expected")).alias("detection_rate"),
        ratio(F.sum("fp"), F.sum("fp") + F.sum("tp")).alias("false_positive_rate"),
        F.coalesce(F.avg(F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))), F.lit(0.0)).alias("pattern_precision"),
    )


def work_indicators(events: DataFrame) -> DataFrame:
    """One row: the five indicators of typed metric events beside detection: scaffolds
    that compile, findings resolved without a person, mean scan time, mean tokens of a
    resolution, and findings that went to a person."""
    kind = lambda k: F.col("event_type") == k
    share = lambda k, what: ratio(F.count_if(kind(k) & F.coalesce(what, F.lit(False))), F.count_if(kind(k)))
    mean = lambda k, c: F.coalesce(F.avg(F.when(kind(k), F.col(c))), F.lit(0.0))
    return events.agg(
        share("scaffold", F.col("compiled")).alias("scaffold_compile_rate"),
        share("verdict", F.col("auto_resolved")).alias("llm_autonomy"),
        mean("timing", "duration_seconds").alias("time_to_detection"),
        mean("verdict", "tokens_used").alias("token_efficiency"),
        share("verdict", ~F.col("auto_resolved")).alias("escalation_rate"),
    )


def history_statistics(points: DataFrame, since: Column) -> DataFrame:
    """min, max, avg, latest and count of each metric's points from since on."""
    return points.where(F.col("ts") >= since).groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.max_by("value", "ts").alias("latest"), F.count("*").alias("count"))


def histogram(rows: DataFrame, column: str, values: list[str] | tuple[str, ...]) -> DataFrame:
    """A count for every value, also for those that do not occur."""
    enum = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(enum).join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def gate(latest: DataFrame) -> DataFrame:
    """One row: any_warning, any_critical and passed, over rows with status."""
    return latest.agg(F.coalesce(F.bool_or(F.col("status") == "warning"), F.lit(False)).alias("any_warning"), F.coalesce(F.bool_or(F.col("status") == "critical"), F.lit(False)).alias("any_critical")).withColumn("passed", ~F.col("any_critical"))
