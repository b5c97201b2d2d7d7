"""The property graph: node and edge tables by type, over DataFrames.

A typed scan reads only the tables of its types, so Catalyst prunes files and
columns below it. Nodes have id, type and label, and a column for each property;
edges have id, type, source and target, and optional weight inputs. A property
that a type lacks is null: unknown, never false.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "type", "label")
EDGE_COLUMNS = ("id", "type", "source", "target")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass(frozen=True)
class PropertyGraph:
    node_tables: Mapping[str, DataFrame]
    edge_tables: Mapping[str, DataFrame]
    meta: Mapping[str, str] = field(default_factory=dict)
    #: By node type, the integer column that makes the id: "Type:" and its digits.
    keys: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str], meta: Mapping[str, str] | None = None) -> PropertyGraph:
        """A graph kept in two tables; a type is a filter that reaches the scan."""
        return cls({t: nodes.where(F.col("type") == t) for t in node_types}, {t: edges.where(F.col("type") == t) for t in edge_types}, meta or {})

    def nodes(self, *types: str) -> DataFrame:
        chosen = [self.node_tables[t] for t in (types or self.node_tables) if t in self.node_tables]
        if not chosen:
            return _union(list(self.node_tables.values())).where(F.lit(False))
        return _union(chosen)

    def edges(self, *types: str, direction: str = "out") -> DataFrame:
        chosen = [self.edge_tables[t] for t in (types or self.edge_tables) if t in self.edge_tables]
        out = _union(chosen) if chosen else _union(list(self.edge_tables.values())).where(F.lit(False))
        if direction == "in":
            names = {"source": "target", "target": "source"}
            out = out.select(*(F.col(c).alias(names.get(c, c)) for c in out.columns))
        return out

    def properties(self, *types: str) -> set[str]:
        chosen = types or tuple(self.node_tables)
        return {c for t in chosen if t in self.node_tables for c in self.node_tables[t].columns} - set(NODE_COLUMNS)

    def node_ids(self, ids: list[str]) -> DataFrame:
        """Id lookup; an id names its type, so other tables are not read. Where a type
        has a key column the filter is on that, and reaches the scan."""
        types = sorted({i.split(":", 1)[0] for i in ids} & set(self.node_tables))
        if not types:
            return self.nodes().where(F.col("id").isin(ids))
        found = []
        for t in types:
            own = [i for i in ids if i.startswith(f"{t}:")]
            nodes = self.node_tables[t]
            if t in self.keys:
                digits = [i[len(t) + 1 :] for i in own]
                nodes = nodes.where(F.col(self.keys[t]).isin([int(x) for x in digits if x.isdecimal() and str(int(x)) == x and int(x) < 1 << 63]))
            else:
                nodes = nodes.where(F.col("id").isin(own))
            found.append(nodes)
        return _union(found)


def key(type_: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{type_}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _nodes(df: DataFrame, type_: str, id_col: str, label: Column, **props: Column) -> DataFrame:
    return df.select(key(type_, id_col).alias("id"), F.lit(type_).alias("type"), label.cast("string").alias("label"), *(c.alias(n) for n, c in props.items()))


def _edges(df: DataFrame, type_: str, source: Column, target: Column, **props: Column) -> DataFrame:
    return df.select(F.concat_ws("->", source, target).alias("id"), F.lit(type_).alias("type"), source.alias("source"), target.alias("target"), *(c.alias(n) for n, c in props.items()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The TPC-H-like tables as a graph."""
    t = lambda name: read(spark, sf_dir, name)
    c = F.col
    nodes = {
        "Region": _nodes(t("region"), "Region", "r_regionkey", c("r_name"), key=c("r_regionkey").cast("bigint")),
        "Nation": _nodes(t("nation"), "Nation", "n_nationkey", c("n_name"), key=c("n_nationkey").cast("bigint")),
        "Customer": _nodes(t("customer"), "Customer", "c_custkey", c("c_name"), key=c("c_custkey"), acctbal=c("c_acctbal"), mktsegment=c("c_mktsegment"), is_indebted=c("c_acctbal") < 0, is_wealthy=c("c_acctbal") > 9000),
        "Supplier": _nodes(t("supplier"), "Supplier", "s_suppkey", c("s_name"), key=c("s_suppkey"), acctbal=c("s_acctbal"), is_indebted=c("s_acctbal") < 0, is_wealthy=c("s_acctbal") > 9000),
        "Part": _nodes(t("part"), "Part", "p_partkey", c("p_name"), key=c("p_partkey"), brand=c("p_brand"), ptype=c("p_type"), size=c("p_size"), retailprice=c("p_retailprice"), is_large=c("p_size") >= 40),
        "Order": _nodes(t("orders"), "Order", "o_orderkey", c("o_orderkey"), key=c("o_orderkey"), status=c("o_orderstatus"), totalprice=c("o_totalprice"), priority=c("o_orderpriority"), is_open=c("o_orderstatus") == "O"),
    }
    line = t("lineitem")
    order = key("Order", "l_orderkey")
    edges = {
        "IN_REGION": _edges(t("nation"), "IN_REGION", key("Nation", "n_nationkey"), key("Region", "n_regionkey")),
        "IN_NATION": _edges(t("customer"), "IN_NATION", key("Customer", "c_custkey"), key("Nation", "c_nationkey")).unionByName(_edges(t("supplier"), "IN_NATION", key("Supplier", "s_suppkey"), key("Nation", "s_nationkey"))),
        "PLACED": _edges(t("orders"), "PLACED", key("Customer", "o_custkey"), key("Order", "o_orderkey")),
        "CONTAINS_PART": _edges(line, "CONTAINS_PART", order, key("Part", "l_partkey"), risk_score=c("l_discount"), is_tainted=c("l_returnflag") == "R", has_guard=c("l_linestatus") == "F"),
        "SHIPPED_BY": _edges(line, "SHIPPED_BY", order, key("Supplier", "l_suppkey")),
    }
    return PropertyGraph(nodes, edges, {"schema_version": "1", "scope": "trade"}, dict.fromkeys(nodes, "key"))


def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Events as nodes, an edge from each event to the next of its user."""
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = events.select("event_id", following.alias("next_id")).where("next_id is not null")
    nodes = {"Event": _nodes(events, "Event", "event_id", F.col("event_type"), key=F.col("event_id"), user_id=F.col("user_id"), event_type=F.col("event_type"), value=F.col("value"))}
    return PropertyGraph(nodes, {"NEXT_STEP": _edges(steps, "NEXT_STEP", key("Event", "event_id"), key("Event", "next_id"))}, {"schema_version": "1", "scope": "events"}, {"Event": "key"})
