"""Rules: YAML to predicates, many rules in one scan, findings and reports.

Rules that only look at a node's own columns are fused: one scan of a scope
evaluates all of them and explodes the ids of those that hold. Rules with edges,
paths or labels add semi joins over the nodes that their columns let through.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import NODE_COLUMNS, PropertyGraph
from loomgraph.predicates import Condition, Match, clause_status, condition, happens_before, has_all_operations, has_any_operation, has_operation, match, operator, signature_matches, tiers

# Severities, lowest first, and other names for them.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_NAMES = {"informational": "info", "note": "info", "none": "info", "warning": "medium", "error": "high"}
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
_OPERATION_KEYS = ("has_operation", "has_all_operations", "has_any_operation", "sequence_order", "signature_matches")


class RuleSourceError(ValueError):
    """The rule folder is missing, or holds no rule."""


@dataclass(frozen=True)
class LabelTest:
    kind: str  # has_label or missing_label
    label: str
    min_confidence: str = "low"


@dataclass(frozen=True)
class Rule:
    id: str
    scope: str = "Function"
    severity: str = "medium"
    lens: tuple[str, ...] = ()
    name: str = ""
    match: Match = Match()
    operations: tuple[tuple[str, str, Any], ...] = ()  # (all, any or none; kind; value)
    risk_tags: tuple[str, ...] = ()
    labels: tuple[LabelTest, ...] = ()
    required_labels: tuple[str, ...] = ()
    edges: tuple[Any, ...] = ()
    paths: tuple[Any, ...] = ()
    mode: str = "tier_a_only"

    def conditions(self) -> list[Condition]:
        return [*self.match.all, *self.match.any, *self.match.none]


def severity(name: str | None) -> str:
    """Lower case, with other names of a severity replaced; unknown ones stay."""
    low = (name or "medium").lower()
    return SEVERITY_NAMES.get(low, low)


def _items(block: dict | None, key: str) -> list:
    return list((block or {}).get(key) or [])


def rule_from(obj: dict) -> Rule:
    from loomgraph.plans.plan import edge_from, path_from

    body = obj.get("match") or {}
    a, b, c = (body.get("tier_a") or body), body.get("tier_b") or {}, body.get("tier_c") or {}
    plain: dict[str, list[Condition]] = {"all": [], "any": [], "none": []}
    operations, tags, labels = [], [], []
    for part in plain:
        for x in _items(a, part):
            if "property" in x:
                plain[part].append(Condition(x["property"], operator(x.get("op")), x.get("value", True)))
            for k in _OPERATION_KEYS:
                if k in x:
                    operations.append((part, k, x[k]))
        for x in _items(b, part):
            tags += [x["has_risk_tag"]] if "has_risk_tag" in x else [x["value"]] if x.get("type") == "has_risk_tag" else []
    found = [x for part in plain for x in _items(c, part)] if isinstance(c, dict) else list(c)
    for x in found:
        kind = x.get("type") or next((k for k in ("has_label", "missing_label") if k in x), None)
        if kind in ("has_label", "missing_label"):
            labels.append(LabelTest(kind, x.get("value") or x.get(kind), x.get("min_confidence", "low")))
    return Rule(
        id=obj["id"],
        scope=obj.get("scope", "Function"),
        severity=severity(obj.get("severity")),
        lens=tuple(obj.get("lens") or ()),
        name=obj.get("name", ""),
        match=Match(*(tuple(plain[p]) for p in ("all", "any", "none"))),
        operations=tuple(operations),
        risk_tags=tuple(tags),
        labels=tuple(labels),
        required_labels=tuple((c.get("required_labels") if isinstance(c, dict) else None) or obj.get("required_labels") or ()),
        edges=tuple(map(edge_from, obj.get("edges") or body.get("edges") or ())),
        paths=tuple(map(path_from, obj.get("paths") or body.get("paths") or ())),
        mode=(obj.get("aggregation") or {}).get("mode", "tier_a_only"),
    )


def load_rules(folder: str) -> list[Rule]:
    """Rules of all */patterns/*.yaml below a folder; files without a match block
    (recipes) are left out. The files are a few hundred, so the driver reads them."""
    import yaml

    root = Path(folder)
    if not root.is_dir():
        raise RuleSourceError(f"there is no rule folder {folder}")
    files = sorted(root.glob("**/patterns/*.yaml"))
    if not files:
        raise RuleSourceError(f"{folder} holds no */patterns/*.yaml")
    docs = [d for f in files for d in yaml.safe_load_all(f.read_text()) if isinstance(d, dict)]
    return [rule_from(d) for d in docs if d.get("id") and d.get("match")]


def select_rules(rules: Iterable[Rule], ids: Iterable[str] = (), lens: Iterable[str] = (), severities: Iterable[str] = ()) -> list[Rule]:
    ids, lens, severities = set(ids), {x.lower() for x in lens}, {severity(s) for s in severities}
    return [r for r in rules if (not ids or r.id in ids) and (not lens or lens & {x.lower() for x in r.lens}) and (not severities or r.severity in severities)]


def _operation(kind: str, value: Any, known: set[str]) -> Column:
    if kind == "signature_matches":
        return signature_matches(F.col("behavioral_signature"), value) if "behavioral_signature" in known else F.lit(False)
    if "operations" not in known:
        return F.lit(False)
    ops = F.col("operations")
    if kind == "sequence_order":
        return happens_before(ops, value["before"], value["after"])
    return {"has_operation": has_operation, "has_all_operations": has_all_operations, "has_any_operation": has_any_operation}[kind](ops, value)


def own_columns(rule: Rule, known: set[str]) -> Column:
    """What a node's own columns say of the rule (tier A)."""
    out = match(rule.match, known)
    for part in ("all", "any", "none"):
        each = [_operation(k, v, known) for p, k, v in rule.operations if p == part]
        if not each:
            continue
        one = each[0]
        for x in each[1:]:
            one = one & x if part == "all" else one | x
        if part == "any" and rule.match.any:
            # properties and operations of an any block are alternatives of each other
            base = match(Match(rule.match.all, (), rule.match.none), known)
            out = base & (match(Match((), rule.match.any), known) | one)
        else:
            out = out & (~one if part == "none" else one)
    return out


def _explain(rule: Rule, known: set[str]) -> Column:
    clauses = [(part, c) for part in ("all", "any", "none") for c in getattr(rule.match, part)]
    if not clauses:
        return F.array().cast("array<struct<clause:string,status:string>>")
    return F.array(*(F.struct(F.lit(f"{part}: {c.property} {operator(c.op)} {c.value}").alias("clause"), clause_status(c, known).alias("status")) for part, c in clauses))


def _with_labels(nodes: DataFrame, rule: Rule, labels: DataFrame | None) -> DataFrame:
    """Semi and anti joins for label tests; a node whose required labels are not all
    there is undecided and no finding."""
    for test in rule.labels:
        if labels is None:
            return nodes.where(F.lit(False))
        rank = CONFIDENCE_RANK.get(test.min_confidence, 1)
        own = labels.where((F.col("label_id") == test.label) & (confidence_rank(F.col("confidence")) >= rank)).select(F.col("function_id").alias("__f"))
        nodes = nodes.join(own, F.col("id") == F.col("__f"), "left_semi" if test.kind == "has_label" else "left_anti")
    if rule.required_labels and labels is not None:
        held = labels.where(F.col("label_id").isin(list(rule.required_labels))).groupBy(F.col("function_id").alias("__f")).agg(F.count_distinct("label_id").alias("__n")).where(F.col("__n") == len(set(rule.required_labels)))
        nodes = nodes.join(held.select("__f"), F.col("id") == F.col("__f"), "left_semi")
    return nodes


# Why evidence may be missing, and why something was left out.
EVIDENCE_MISSING = {
    "taint_dataflow_unavailable": "Taint analysis not available",
    "dominance_unknown": "Dominance cannot be proven",
    "interprocedural_truncated": "Cross-function analysis truncated",
    "external_return_untracked": "External return values not tracked",
    "aliasing_unknown": "Storage aliasing uncertain",
    "sanitizer_uncertain": "Sanitizer effect uncertain",
    "legacy_no_evidence": "Legacy v1 output without evidence",
}
OMISSION = {
    "modifier_not_traversed": "Modifier body not analyzed",
    "inherited_not_traversed": "Inherited function not analyzed",
    "external_target_unknown": "External call target unknown",
    "budget_exceeded": "Token budget exceeded",
    "depth_limit_reached": "Analysis depth limit reached",
    "library_excluded": "Library code excluded",
}


def reason_codes(spark) -> DataFrame:
    """(kind, code, meaning) of both vocabularies."""
    rows = [("evidence_missing", c, m) for c, m in EVIDENCE_MISSING.items()] + [("omission", c, m) for c, m in OMISSION.items()]
    return spark.createDataFrame(rows, "kind string, code string, meaning string")


def label_coverage(nodes: DataFrame, required: tuple[str, ...], labels: DataFrame) -> DataFrame:
    """nodes with held (how many of the required labels) and coverage: "decided" if all are
    there, "unknown" if some are, "skippable" if none is. What run_rules leaves out as
    undecided is what has not "decided" here."""
    held = labels.where(F.col("label_id").isin(list(required))).groupBy(F.col("function_id").alias("__f")).agg(F.count_distinct("label_id").alias("held"))
    out = nodes.join(held, F.col("id") == F.col("__f"), "left").drop("__f").withColumn("held", F.coalesce("held", F.lit(0)).cast("int"))
    return out.withColumn("coverage", F.when(F.col("held") >= len(set(required)), "decided").when(F.col("held") > 0, "unknown").otherwise("skippable"))


def graph_slice(graph: PropertyGraph, rules: list[Rule], lens: str | None = None, rule_id: str | None = None) -> PropertyGraph:
    """The graph with only the node types that the rules of a lens (or one rule) look
    at, and of those only the properties that their conditions name."""
    chosen = select_rules(rules, [rule_id] if rule_id else [], [lens] if lens else [])
    wanted: dict[str, set[str]] = {}
    for r in chosen:
        wanted.setdefault(r.scope, set()).update(c.property for c in r.conditions())
        for e in [*r.edges, *(s for p in r.paths for s in p.steps)]:
            if e.target_type:
                own = wanted.setdefault(e.target_type, set())
                if e.target_match is not None:
                    own.update(c.property for part in ("all", "any", "none") for c in getattr(e.target_match, part))
    nodes = {t: df.select(*(c for c in df.columns if c in NODE_COLUMNS or c in wanted[t])) for t, df in graph.node_tables.items() if t in wanted}
    types = {t for r in chosen for e in [*r.edges, *(s for p in r.paths for s in p.steps)] for t in ([e.type] if isinstance(e.type, str) else e.type)}
    return PropertyGraph(nodes, {t: df for t, df in graph.edge_tables.items() if t in types}, graph.meta)


_FLIPPED = {"eq": "neq", "neq": "eq", "in": "not_in", "not_in": "in", "gt": "lte", "lte": "gt", "gte": "lt", "lt": "gte"}


def mutations(rule: Rule, factor: float = 1.1) -> list[Rule]:
    """Rules that differ from rule in one required condition: without it, with its
    operator turned round, and with its threshold times factor. Each has a name of its own."""
    out = []
    for k, c in enumerate(rule.match.all):
        changes: list[tuple[str, tuple[Condition, ...]]] = [(f"drop {c.property}", ())]
        if (op := operator(c.op)) in _FLIPPED:
            changes.append((f"flip {c.property}", (replace(c, op=_FLIPPED[op]),)))
        if isinstance(c.value, (int, float)) and not isinstance(c.value, bool):
            changes.append((f"{c.property} * {factor:g}", (replace(c, value=c.value * factor),)))
        for name, new in changes:
            out.append(replace(rule, id=f"{rule.id}~{name}", match=replace(rule.match, all=(*rule.match.all[:k], *new, *rule.match.all[k + 1 :]))))
    return out


def confidence_rank(confidence: Column) -> Column:
    return F.when(F.lower(confidence) == "high", 3).when(F.lower(confidence) == "medium", 2).when(F.lower(confidence) == "low", 1).otherwise(0)


def _finding(rule: Rule, explain: bool, known: set[str]) -> list[Column]:
    out = [F.lit(rule.id).alias("pattern_id"), F.lit(rule.severity).alias("severity"), F.array(*map(F.lit, rule.lens)).cast("array<string>").alias("lens")]
    return [*out, _explain(rule, known).alias("explain")] if explain else out


def run_rules(graph: PropertyGraph, rules: list[Rule], explain: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """Findings: pattern_id, severity, lens, node_id, node_label, and explain if asked for."""
    from loomgraph.plans.run import require_edge, require_path

    spark = next(iter(graph.node_tables.values())).sparkSession
    fields = "pattern_id string, severity string, lens array<string>, node_id string, node_label string"
    empty = spark.createDataFrame([], fields + (", explain array<struct<clause:string,status:string>>" if explain else ""))
    parts = [empty]
    for scope in sorted({r.scope for r in rules}):
        if scope not in graph.node_tables:
            continue
        nodes = graph.nodes(scope)
        known = set(nodes.columns)
        own = [r for r in rules if r.scope == scope]
        fused = [r for r in own if not (r.edges or r.paths or r.labels or r.required_labels)]
        if fused:
            hit = F.array(*(F.when(_holds(r, known), F.struct(*_finding(r, explain, known))) for r in fused))
            rows = nodes.select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.explode(F.array_compact(hit)).alias("f"))
            parts.append(rows.select("f.*", "node_id", "node_label").select(*empty.columns))
        for r in own:
            if r in fused:
                continue
            some = nodes.where(_holds(r, known))
            for e in r.edges:
                some = require_edge(some, graph, e)
            for p in r.paths:
                some = require_path(some, graph, p)
            some = _with_labels(some, r, labels)
            parts.append(some.select(*_finding(r, explain, known), F.col("id").alias("node_id"), F.col("label").alias("node_label")).select(*empty.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _holds(rule: Rule, known: set[str]) -> Column:
    b = None
    if rule.risk_tags:
        b = F.coalesce(F.arrays_overlap(F.col("risk_tags"), F.array(*map(F.lit, rule.risk_tags))), F.lit(False)) if "risk_tags" in known else F.lit(False)
    return tiers(own_columns(rule, known), b if b is not None else F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), rule.mode)


def rules_table(spark, rules: list[Rule]) -> DataFrame:
    """Metadata of rules, for joins and distributions."""
    rows = [(r.id, r.name, r.scope, r.severity, list(r.lens), r.mode, len(r.conditions())) for r in rules]
    return spark.createDataFrame(rows, "id string, name string, scope string, severity string, lens array<string>, mode string, n_conditions int")


def lens_report(findings: DataFrame, owner: DataFrame, lenses: list[str], part_rows: int = 10_000) -> DataFrame:
    """A row for each owner (or "unknown") and part: a count for each lens over all of
    the owner's findings, 0 if none, and the part's findings in order. An owner with
    more than about part_rows findings has several parts, so that no row holds them
    all. owner: node_id, owner."""
    own = findings.join(owner.withColumnRenamed("node_id", "__n"), F.col("node_id") == F.col("__n"), "left").withColumn("owner", F.coalesce("owner", F.lit("unknown")))
    counts = own.groupBy("owner").agg(*(F.count_if(F.array_contains("lens", x)).alias(x) for x in lenses), F.count("*").alias("total"))
    parts = own.join(counts.select(F.col("owner").alias("__o"), F.ceil(F.col("total") / part_rows).alias("__parts")), F.col("owner") == F.col("__o"))
    parts = parts.groupBy("owner", F.pmod(F.xxhash64("node_id", "pattern_id"), F.col("__parts")).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("pattern_id", "node_id", "severity"))).alias("findings"))
    return counts.join(parts, "owner").select("owner", "part", *lenses, "total", "findings").orderBy("owner", "part")


def clause_matrix(findings_explain: DataFrame, unknown_share: float = 0.3, unknown_most: int = 2) -> DataFrame:
    """Matched, failed and unknown clauses of each finding, and whether the evidence
    suffices: at most unknown_most unknown clauses and unknown_share of all."""
    pick = lambda s: F.transform(F.filter("explain", lambda x: x["status"] == s), lambda x: x["clause"])
    out = findings_explain.withColumns({f"{s}_clauses": pick(s) for s in ("matched", "failed", "unknown")})
    n, u = F.size("explain"), F.size("unknown_clauses")
    return out.withColumn("verdict", F.when((u > unknown_most) | (u > n * unknown_share), "insufficient_evidence").otherwise("supported"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")
