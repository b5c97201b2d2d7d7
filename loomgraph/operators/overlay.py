"""Overlays, label functions, work items and context items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.labels import categories
from loomgraph.operators.rules import confidence_rank


def merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The union of both; on equal keys the right row stays."""
    kept = left.join(right.select(*(F.col(k).alias(f"__{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return kept.unionByName(right)


def label_profile(labels: DataFrame, function: str = "function_id", label: str = "label_id") -> DataFrame:
    """Each function's number of labels, the labels, their categories and best confidence."""
    return labels.groupBy(function).agg(F.count("*").alias("n_labels"), F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(categories(F.col(label)))))).alias("categories"), F.max(confidence_rank(F.col("confidence"))).alias("best"))


def with_any_label(nodes: DataFrame, labels: DataFrame, wanted: list[str], least: str = "low", every: bool = False) -> DataFrame:
    rank = {"low": 1, "medium": 2, "high": 3}[least]
    held = labels.where(F.col("label_id").isin(wanted) & (confidence_rank(F.col("confidence")) >= rank)).groupBy(F.col("function_id").alias("__f")).agg(F.count_distinct("label_id").alias("__n"))
    held = held.where(F.col("__n") == len(set(wanted))) if every else held
    return nodes.join(held.select("__f"), F.col("id") == F.col("__f"), "left_semi")


# Work items: an append-only log; the last line of an id is its state.


def current(log: DataFrame, key: str = "id", position: str = "log_pos") -> DataFrame:
    """By position in the log, never by time; one aggregate, no sort of the log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), position).alias("x")).select(key, "x.*")


def chosen(items: DataFrame, status: str | None = None, severity: str | None = None, parent: str | None = None) -> DataFrame:
    for column, wanted in (("status", status), ("severity", severity), ("parent_id", parent)):
        if wanted:
            items = items.where(F.col(column) == wanted)
    return items.orderBy("priority", "created_at")


def ready(items: DataFrame) -> DataFrame:
    """Open items all of whose blockers are complete; an unknown blocker blocks."""
    done = items.where("status = 'complete'").select(F.col("id").alias("__d"))
    open_ = items.where("status = 'open'")
    waits = open_.select("id", F.explode("blockers").alias("__b")).join(done, F.col("__b") == F.col("__d"), "left_anti").select(F.col("id").alias("__w")).distinct()
    return open_.join(waits, F.col("id") == F.col("__w"), "left_anti").orderBy("priority", "created_at")


def find_item(items: DataFrame, id_: str, pool: str | None = None) -> DataFrame:
    """The item in its pool; without one, the unassigned pool first, then the first that has it."""
    rows = items.where(F.col("id") == id_)
    if pool:
        return rows.where(F.col("pool") == pool)
    return rows.orderBy(F.col("pool") != "unassigned", "pool").limit(1)


# Context items


def context_pack(items: DataFrame, ids: DataFrame | None = None, by: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """Items in order of (type, name) joined by blank lines, with their count and bytes;
    ids that no item has are ignored. A pack of more than most_bytes goes on in the next
    part, in the same order, so that no row holds more than that and one item."""
    if ids is not None:
        items = items.join(ids.select(F.col("id").alias("__k")), F.col("id") == F.col("__k"), "left_semi")
    keys = [by] if by else []
    order = Window.partitionBy(*keys).orderBy("type", "name", "content").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    items = items.withColumn("part", F.floor(F.coalesce(F.sum(size).over(order), F.lit(0)) / most_bytes))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("type", "name", "content"))), lambda x: x["content"])
    return items.groupBy(*keys, "part").agg(F.count("*").alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.array_join(ordered, "\n\n").alias("pack"))


def attempts(calls: DataFrame, key: str = "session_id") -> DataFrame:
    """State of each session's queries: success, failed, not_attempted or unavailable,
    and its severity. calls: key, available, is_query, is_error."""
    state = F.when(~F.bool_or("available"), "unavailable").when(F.bool_or(F.col("is_query") & ~F.col("is_error")), "success").when(F.bool_or("is_query"), "failed").otherwise("not_attempted")
    out = calls.groupBy(key).agg(state.alias("state"))
    return out.withColumn("severity", F.when(F.col("state") == "failed", "critical").when(F.col("state").isin("not_attempted", "unavailable"), "warning").otherwise("info"))


def is_error(text, words: list[str]):
    """A short text is an error if it has an indicator anywhere, a longer one if its first line has."""
    pattern = "(?i)" + "|".join(words)
    return F.when(F.length(text) < 50, text.rlike(pattern)).otherwise(F.get(F.split(text, "\n"), F.lit(0)).rlike(pattern))


def latest_by_window(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
