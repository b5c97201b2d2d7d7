"""Streams of events: windows, sessions, health, alerts, incremental differences.

The semantics are this package's own. Event time is a timestamp (a zoneless one
is cast, since a watermark needs that); what comes later than the watermark is
dropped. The same functions take a batch, for which the watermark has no effect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.workers import ready


def watch(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100, form: str = "parquet") -> DataFrame:
    """Files that appear in a folder, as a stream."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, by: list[str], aggs: dict[str, Column], ts: str = "ts", slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *by).agg(*(c.alias(n) for n, c in aggs.items())).select(F.col("w.start").alias("window_start"), *by, *aggs)


def sessions(events: DataFrame, key: str, gap: str, aggs: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Runs of a key's events with less than gap between them."""
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, *aggs)


@dataclass(frozen=True)
class HealthFactors:
    """Weights of what lowers a score of 100."""

    errors: float = 50.0
    slow: float = 30.0
    silence: float = 20.0


def health(events: DataFrame, width: str, by: list[str], is_error: Column, is_slow: Column, quiet_below: int = 1, factors: HealthFactors = HealthFactors(), ts: str = "ts") -> DataFrame:
    n = F.count("*")
    score = 100 - factors.errors * F.count_if(is_error) / n - factors.slow * F.count_if(is_slow) / n - F.when(n < quiet_below, factors.silence).otherwise(0.0)
    return tumbling(events, width, by, {"events": n, "score": F.greatest(score, F.lit(0.0))}, ts)


@dataclass(frozen=True)
class AlertRule:
    name: str
    holds: Column
    severity: str = "warning"


def alerts(rows: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """A row for each row and rule that holds; all rules in one pass."""
    hit = F.array(*(F.when(F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules))
    return rows.select("*", F.explode(F.array_compact(hit)).alias("__a")).select("*", "__a.rule", "__a.severity").drop("__a")


def cooled(alerts_: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, ts, alerts): each key's first alert, then the first one at least `seconds`
    after the last that came out, with how many alerts each stands for. Alerts of one
    key and time are counted first; a key's times are then walked in order, one at a
    time, with one number held. A null time comes never out."""
    rows = alerts_.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).agg(F.count("*").alias("__n"))
    ready(rows.sparkSession)
    kind = dict(rows.dtypes)["__key"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    walked = rows.repartition(parts, "__key").sortWithinPartitions("__key", "__at").mapInArrow(_cool(seconds * 1_000_000), f"__key {kind}, __at bigint, __n bigint")
    return walked.select(F.col("__key").alias(key), F.timestamp_micros("__at").alias(ts), F.col("__n").alias("alerts"))


def _cool(gap: int):
    """Rows come by key in order of time."""

    def run(batches):
        import pyarrow as pa

        held: list | None = None  # key, when it came out, alerts since
        for batch in batches:
            out = []
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == k and at < held[1] + gap:
                    held[2] += n
                    continue
                if held is not None:
                    out.append(held)
                held = [k, at, n]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(batch.schema)], schema=batch.schema)
            schema = batch.schema
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[j]], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def difference(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, change): added, removed or modified, by a hash of the content."""
    h = F.xxhash64(*content)
    a, b = old.select(key, h.alias("__a")), new.select(key, h.alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def changed(new: DataFrame, known_hashes: DataFrame, content: list[str]) -> DataFrame:
    """Rows whose content was not seen: what an incremental build has to do."""
    h = F.sha2(F.to_json(F.struct(*content)), 256)
    return new.withColumn("content_hash", h).join(known_hashes.select(F.col("content_hash").alias("__h")), F.col("content_hash") == F.col("__h"), "left_anti")


def stream_statistics(events: DataFrame, by: list[str], ts: str = "timestamp") -> DataFrame:
    """Duration, agents by type and completed tasks of event streams."""
    return events.groupBy(*by).agg((F.max(ts) - F.min(ts)).alias("duration"), F.array_sort(F.collect_set("agent_type")).alias("agent_types"), F.count_distinct("agent_id").alias("agents"), F.count_if(F.col("type") == "task_completed").alias("completed"))


class Session:
    """The life of a streaming query: start, drain, stop."""

    def __init__(self, df: DataFrame, checkpoint: str | None = None, mode: str = "append"):
        self.df, self.checkpoint, self.mode, self.query = df, checkpoint, mode, None

    def _writer(self):
        w = self.df.writeStream.outputMode(self.mode).trigger(availableNow=True)
        return w.option("checkpointLocation", self.checkpoint) if self.checkpoint else w

    def to_files(self, path: str) -> Session:
        self.query = self._writer().format("parquet").option("path", path).start()
        return self

    def to_memory(self, name: str) -> Session:
        self.query = self._writer().format("memory").queryName(name).start()
        return self

    def each_batch(self, act: Callable[[DataFrame, int], None]) -> Session:
        self.query = self._writer().foreachBatch(act).start()
        return self

    @property
    def status(self) -> str:
        if self.query is None:
            return "created"
        if self.query.isActive:
            return "running"
        return "failed" if self.query.exception() else "finished"

    def drain(self, seconds: int = 600) -> Session:
        self.query.awaitTermination(seconds)
        if self.query.exception():
            raise RuntimeError(str(self.query.exception()))
        return self

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
