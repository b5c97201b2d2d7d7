"""Sources and sinks: graph files, logs, snapshots, tool findings, hook payloads.

Data goes through Spark's readers, so any path that Spark can open works. Only
rule, benchmark and recipe files (a few hundred small YAML files) are read by
the driver.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.names import finding_id
from loomgraph.model import PropertyGraph

NODE_SCHEMA = "id string, type string, label string, properties map<string,string>, evidence array<struct<file:string,line_start:int,line_end:int>>"
EDGE_SCHEMA = "id string, type string, source string, target string"
META_SCHEMA = "schema_version string, build_hash string, timestamp string, scope string"
EVENT_SCHEMA = "event_id string, event_type string, timestamp timestamp, contract_id string, pattern_id string, function_name string, line_number int, expected boolean, detected boolean, operation string, duration_seconds double, finding_id string, compiled boolean, error_message string, verdict string, auto_resolved boolean, tokens_used int"
EVENT_TYPES = ("detection", "timing", "scaffold", "verdict")
WORK_SCHEMA = "log_pos bigint, id string, title string, status string, severity string, priority int, pattern_id string, location string, parent_id string, blockers array<string>, created_at string, updated_at string, agent_id string, work_state map<string,string>, notes string, pool string"


class GraphNotFound(ValueError):
    pass


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and metadata of {nodes, edges, metadata} files."""
    raw = spark.read.option("multiLine", True).schema(f"nodes array<struct<{_struct(NODE_SCHEMA)}>>, edges array<struct<{_struct(EDGE_SCHEMA)}>>, metadata struct<{_struct(META_SCHEMA)}>").json(path)
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("edges").alias("e")).select("e.*"), raw.select("metadata.*")


def _struct(ddl: str) -> str:
    out, depth, parts = "", 0, []
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(out)
            out = ""
        else:
            out += ch
    return ",".join(":".join(p.strip().split(" ", 1)) for p in [*parts, out])


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One line for each node and edge, each in a folder of its own."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def promote(nodes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns for the named properties, typed; what cannot be cast is null."""
    return nodes.select("*", *(F.try_element_at("properties", F.lit(p)).try_cast(k).alias(p) for p, k in kinds.items())).drop("properties")


def validate_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """(check, violations): required fields, locations, metadata, dangling edges."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    ids = nodes.select(F.col("id").alias("__i"))
    located = F.size(F.coalesce("evidence", F.array().cast("array<struct<file:string,line_start:int,line_end:int>>"))) > 0 if "evidence" in nodes.columns else F.lit(True)
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    checks = [
        count(nodes.where(empty("id") | empty("type")), "node fields"),
        count(nodes.where(~located), "node location"),
        count(edges.where(empty("source") | empty("target") | empty("type")), "edge fields"),
        count(edges.join(ids, F.col("source") == F.col("__i"), "left_anti"), "edge source"),
        count(edges.join(ids, F.col("target") == F.col("__i"), "left_anti"), "edge target"),
        count(meta.where(empty("schema_version") | empty("build_hash") | empty("timestamp") | empty("scope")), "metadata"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def resolve_graph(catalog: DataFrame, name: str | None = None) -> str:
    """The path of the one graph that name (a path or a stem) means; without a name
    the only one there is. A parquet artefact goes before a JSON one of its stem."""
    rows = catalog if name is None else catalog.where((F.col("path") == name) | (F.col("stem") == name))
    rank = F.when(F.endswith("path", F.lit(".json")), 1).otherwise(0)
    found = rows.groupBy("stem").agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path")).limit(2).collect()
    if len(found) != 1:
        raise GraphNotFound(f"{name or 'the graph'} is {'not there' if not found else 'ambiguous'}")
    return found[0]["path"]


def read_log(spark: SparkSession, path: str, schema: str = WORK_SCHEMA) -> DataFrame:
    """An append-only JSON-lines log; lines that cannot be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def saved(rows: DataFrame, path: str) -> DataFrame:
    """rows written as JSON lines (label overlays, confidence bounds, benchmark results)
    and read again with their own schema."""
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Metric points (ts, run_id, metric, value, ...) of snapshot files, in order of time."""
    value = "value double, target double, threshold_warning double, threshold_critical double, unit string"
    raw = spark.read.schema(f"timestamp timestamp, version string, run_id string, metrics map<string,struct<{_struct(value)}>>").option("mode", "DROPMALFORMED").json(path)
    return raw.where("timestamp is not null").select(F.col("timestamp").alias("ts"), "version", "run_id", F.explode("metrics").alias("metric", "m")).select("ts", "version", "run_id", "metric", "m.*").orderBy("ts", "metric")


def write_snapshots(points: DataFrame, path: str) -> None:
    """By day, and keyed by run: two runs of one second do not overwrite each other."""
    points.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def retain(points: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) points, by age."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    return points.where(F.col("ts") >= cutoff), points.where(F.col("ts") < cutoff)


def decode_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Typed metric events of JSON texts; an unknown event type is an error."""
    e = raw.select(F.from_json(F.col(column).cast("string"), EVENT_SCHEMA).alias("e")).select("e.*")
    known = F.col("event_type").isin(list(EVENT_TYPES))
    bad = F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null"))))
    return e.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(bad)).withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0))).withColumn("auto_resolved", F.coalesce("auto_resolved", F.lit(False)))


def tool_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a {results: [...]} tool report."""
    result = "check_id string, path string, start struct<line:int>, end struct<line:int>, extra struct<message:string,severity:string,lines:string>"
    raw = spark.read.option("multiLine", True).schema(f"results array<struct<{_struct(result)}>>").json(path)
    r = raw.select(F.explode("results").alias("r")).select("r.*")
    return r.select("check_id", "path", F.col("start.line").alias("line_start"), F.col("end.line").alias("line_end"), F.col("extra.message").alias("message"), severity_of(F.col("extra.severity")).alias("severity"), F.col("extra.lines").alias("snippet"))


def sarif_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of SARIF reports, with the tool that made them."""
    schema = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>"
    runs = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("runs").alias("run"))
    r = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return r.select("tool", F.col("r.ruleId").alias("check_id"), severity_of(F.col("r.level")).alias("severity"), F.col("r.message.text").alias("message"), at["artifactLocation"]["uri"].alias("path"), at["region"]["startLine"].alias("line_start"), F.coalesce(at["region"]["endLine"], at["region"]["startLine"]).alias("line_end"))


def severity_of(level: Column) -> Column:
    """One scale for the tools' severities."""
    x = F.lower(level.cast("string"))
    return (
        F.when(x.isin("critical", "4"), "CRITICAL")
        .when(x.isin("high", "error", "3"), "HIGH")
        .when(x.isin("medium", "warning", "2"), "MEDIUM")
        .when(x.isin("low", "1"), "LOW")
        .when(x.isin("info", "informational", "note", "none", "optimization", "0"), "INFO")
        .otherwise(F.upper(level.cast("string")))
    )


def findings_graph(findings: DataFrame, tool: str = "semgrep") -> DataFrame:
    """A node for each finding, with its place as evidence (none without a path)."""
    place = F.struct(F.col("path").alias("file"), "line_start", "line_end")
    none = F.array().cast("array<struct<file:string,line_start:int,line_end:int>>")
    return findings.select(
        finding_id(tool, F.col("check_id"), F.col("path"), F.col("line_start"), F.col("line_end")).alias("id"),
        F.lit("ToolFinding").alias("type"),
        F.col("check_id").alias("label"),
        F.create_map(F.lit("severity"), F.col("severity"), F.lit("message"), F.col("message")).alias("properties"),
        F.when(F.col("path").isNotNull() & (F.col("path") != ""), F.array(place)).otherwise(none).alias("evidence"),
    )


#: Where a hook's observation may stand, in this order, each in its data before the payload itself.
RESPONSE_FIELDS = ("raw_observation", "response_text", "output", "result")


def evaluation_inputs(payloads: DataFrame, queries_field: str = "graph_queries", query_event: str = "graph_query") -> DataFrame:
    """Hook payloads that name a tool use, each with its run id, tools, queries, duration
    and response (cut to 4,000 characters). Tools are the named one, then those of
    tool_sequence; a query event without any was run by Bash. Fields that the
    payloads lack are read as missing."""
    inner, outer = set(payloads.schema["data"].dataType.names), set(payloads.columns)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    found = lambda name: [text(f"data.{name}")] * (name in inner) + [text(name)] * (name in outer)
    none = F.array().cast("array<string>")
    tools = F.when(text("data.tool_name").isNotNull(), F.array("data.tool_name")).otherwise(none) if "tool_name" in inner else none
    if "tool_sequence" in inner:
        tools = F.concat(tools, F.coalesce("data.tool_sequence", none))
    if "event_type" in outer:
        tools = F.when((F.size(tools) == 0) & (F.col("event_type") == query_event), F.array(F.lit("Bash"))).otherwise(tools)
    queries = F.coalesce(F.transform(f"data.{queries_field}", lambda q: q["query_text"]), none) if queries_field in inner else none
    if "query" in inner:
        queries = F.concat(queries, F.when(F.col("data.query").isNotNull(), F.array("data.query")).otherwise(none))
    response = [c for name in RESPONSE_FIELDS for c in found(name)]
    use = F.coalesce(*found("tool_use_id"))
    return (
        payloads.withColumn("use", use)
        .where("use is not null")
        .select(
            F.concat_ws(":", text("session_id"), F.col("use")).alias("run_id"),
            tools.alias("tools"),
            queries.alias("queries"),
            (F.coalesce("data.duration_ms", F.lit(0.0)) if "duration_ms" in inner else F.lit(0.0)).alias("duration_ms"),
            F.substring(F.coalesce(*response, F.lit("")), 1, 4000).alias("response"),
        )
    )


def controller_events(raw: DataFrame) -> DataFrame:
    """Events whose producers name the fields differently, with defaults."""
    pick = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    return raw.select(F.coalesce(pick("type", "event"), F.lit("unknown")).alias("type"), F.coalesce(pick("timestamp").cast("double"), F.lit(0.0)).alias("timestamp"), pick("agent_id", "agentId").alias("agent_id"), pick("agent_type", "agentType", "subagent_type").alias("agent_type"))


def project_rows(df: DataFrame, root: str, path: str = "path", flag: str = "is_dependency") -> DataFrame:
    """Rows of the project: not flagged as a dependency, or, without a flag, below the root."""
    return df.where(F.coalesce(~F.col(flag), F.startswith(path, F.lit(root))))


# YAML: read by the driver, a few hundred small files.


def _yaml(path: Path) -> list[dict]:
    import yaml

    return [d for d in yaml.safe_load_all(path.read_text()) if isinstance(d, dict)]


def benchmark_suite(spark: SparkSession, path: str) -> DataFrame:
    """A row for each challenge of a suite file; the suite's status goes before the
    challenge's own; challenges without a file are left out."""
    file = Path(path)
    rows = []
    for suite in _yaml(file):
        for ref in suite.get("challenges", []):
            own = file.parent / (ref.get("file") or f"{ref.get('id')}.yaml")
            if not own.exists():
                continue
            for c in _yaml(own):
                names = [d.get("pattern", "") for d in c.get("expected_detections", [])]
                rows.append((suite.get("name", ""), c.get("id") or ref.get("id"), ref.get("status") or c.get("status", "pending"), c.get("vulnerability_type", ""), c.get("severity", ""), names))
    return spark.createDataFrame(rows, "suite string, challenge_id string, status string, vulnerability_type string, severity string, expected array<string>")


def tool_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(id, category, severity) of tool rules in all YAML files below a folder; the
    category falls back to the path's security or performance part."""
    rows = []
    for f in sorted(Path(folder).rglob("*.yaml")):
        for doc in _yaml(f):
            for r in doc.get("rules", []):
                if r.get("id"):
                    part = next((p for p in ("security", "performance") if p in f.parts), None)
                    rows.append((r["id"], (r.get("metadata") or {}).get("category") or part, r.get("severity")))
    return spark.createDataFrame(rows, "id string, category string, severity string")


class Recipes:
    """Investigation recipes, kept by id once read; other files have none."""

    def __init__(self) -> None:
        self.held: dict[str, dict] = {}

    def load(self, path: str) -> dict | None:
        found = next((d for d in _yaml(Path(path)) if d.get("type") == "investigation"), None)
        if found:
            self.held[found["id"]] = found
        return found

    def load_all(self, folder: str) -> dict[str, dict]:
        for f in sorted(Path(folder).rglob("*.yaml")):
            self.load(str(f))
        return self.held


def trigger(recipe: dict, known: set[str]) -> Column:
    """Whether a node sets a recipe off: any of its graph signals, or all of them."""
    from loomgraph.predicates import Condition, condition

    t: dict[str, Any] = recipe.get("trigger") or {}
    each = [condition(Condition(s["property"], "eq", s.get("value", True)), known) for s in t.get("graph_signals", [])]
    out = F.lit(bool(each))
    for k, c in enumerate(each):
        out = c if k == 0 else (out & c if t.get("require_all") else out | c)
    return out


def graph_tables(graph: PropertyGraph, path: str) -> None:
    """The native artefact: nodes and edges as Parquet by type, so that a typed scan reads its folders only."""
    graph.nodes().write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    graph.edges().write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph_tables(spark: SparkSession, path: str, node_types: list[str], edge_types: list[str]) -> PropertyGraph:
    return PropertyGraph.from_frames(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), node_types, edge_types)
