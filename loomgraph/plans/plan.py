"""Query plans: what a text, JSON or pattern query asks for, before it is run."""

from __future__ import annotations

import difflib
from collections.abc import Collection, Iterable
from dataclasses import dataclass, field
from typing import Any

from loomgraph.predicates import OPERATORS, Condition, Match, conditions_of, operator

META_KEYS = ("rule_confidence", "rule_candidates", "parse_error", "parse_hint")
DEFAULT_LIMIT = 50
SUGGESTIONS, LEAST_LIKENESS = 3, 0.78


@dataclass(frozen=True)
class EdgeSpec:
    type: str
    direction: str = "out"
    target_type: str | None = None
    target_match: Match | None = None


@dataclass(frozen=True)
class PathSpec:
    """Either steps, or up to max_depth edges of one or more types."""

    steps: tuple[EdgeSpec, ...] = ()
    edge_types: tuple[str, ...] = ()
    direction: str = "out"
    max_depth: int = 1
    min_depth: int = 1
    target_type: str | None = None
    source: Match | None = None
    source_type: str | None = None


@dataclass(frozen=True)
class FlowSpec:
    from_type: str | None = None
    from_where: Any = None
    from_kinds: tuple[str, ...] = ()
    exclude_sources: tuple[str, ...] = ()
    to_type: str | None = None
    to_where: Any = None
    edge_types: tuple[str, ...] = ()
    direction: str = "out"
    max_depth: int = 5
    unsafe_only: bool = False


@dataclass
class Plan:
    kind: str = "logic"
    node_types: list[str] = field(default_factory=list)
    edge_types: list[str] = field(default_factory=list)
    node_ids: list[str] = field(default_factory=list)
    properties: dict[str, Any] = field(default_factory=dict)
    where: Any = None
    match: Match | None = None
    edges: list[EdgeSpec] = field(default_factory=list)
    paths: list[PathSpec] = field(default_factory=list)
    flow: FlowSpec | None = None
    patterns: list[str] = field(default_factory=list)
    lens: list[str] = field(default_factory=list)
    severity: list[str] = field(default_factory=list)
    limit: int | None = DEFAULT_LIMIT
    compact: bool = False
    evidence_mode: str = "full"
    explain: bool = False
    include_evidence: bool = True
    min_confidence: float | None = None
    raw_text: str = ""
    warnings: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)

    @property
    def error(self) -> str | None:
        return self.properties.get("parse_error")


def close_matches(name: str, known: Iterable[str]) -> list[str]:
    return difflib.get_close_matches(name, sorted(known), n=SUGGESTIONS, cutoff=LEAST_LIKENESS)


def apply_hints(plan: Plan, known: Collection[str]) -> Plan:
    """Tells of what the schema lacks, with the nearest names; never an error. Every
    condition of the plan is checked, whichever of its forms it came in."""
    trees = [tree for tree in (plan.match, plan.where) if tree is not None]
    asked = [c for tree in trees for c in conditions_of(tree)] + [Condition(p) for p in plan.properties if p not in META_KEYS]
    strange = sorted({c.property for c in asked} - set(known))
    signs = sorted({str(c.op) for c in asked if operator(c.op) not in OPERATORS})
    near = {name: close_matches(name, known) for name in strange}
    plan.warnings = sorted({*plan.warnings, *(f"no node has '{name}'" for name in strange), *(f"'{sign}' is no operator" for sign in signs)})
    plan.hints = sorted({*plan.hints, *(f"nearest to '{name}': {', '.join(found)}" for name, found in near.items() if found), *([f"operators: {', '.join(OPERATORS)}"] if signs else [])})
    return plan


def match_from(obj: dict | None) -> Match | None:
    """A Match from its JSON or YAML form."""
    if not obj:
        return None
    each = lambda xs: tuple(Condition(x["property"], operator(x.get("op")), x.get("value", True)) for x in xs or () if "property" in x)
    return Match(each(obj.get("all")), each(obj.get("any")), each(obj.get("none")))


def edge_from(obj: dict) -> EdgeSpec:
    return EdgeSpec(obj.get("type") or obj.get("edge_type"), obj.get("direction", "out"), obj.get("target_type"), match_from(obj.get("target_match")))


def path_from(obj: dict) -> PathSpec:
    if obj.get("steps"):
        return PathSpec(steps=tuple(map(edge_from, obj["steps"])))
    types = obj.get("edge_types") or ([obj["edge_type"]] if obj.get("edge_type") else [])
    source = Match(all=(Condition(obj["from_property"], "eq", obj.get("from_value", True)),)) if obj.get("from_property") else None
    return PathSpec(edge_types=tuple(types), direction=obj.get("direction", "out"), max_depth=int(obj.get("max_depth", 1)), target_type=obj.get("target_type"), source=source, source_type=obj.get("from_type"))


def flow_from(obj: dict) -> FlowSpec:
    types = obj.get("edge_types") or ([obj["edge_type"]] if obj.get("edge_type") else [])
    return FlowSpec(from_type=obj.get("from_type"), from_kinds=tuple(obj.get("from_kinds", ())), exclude_sources=tuple(obj.get("exclude_sources", ())), to_type=obj.get("target_type"), edge_types=tuple(types), direction="in" if obj.get("direction") == "backward" else obj.get("direction", "out"), max_depth=int(obj.get("max_depth", 5)))


def plan_from(obj: dict, raw: str = "") -> Plan:
    """A plan from a JSON query; without a kind it is a logic query."""
    return Plan(
        kind=obj.get("query_kind") or obj.get("kind") or ("flow" if obj.get("flow") else "logic"),
        node_types=list(obj.get("node_types", [])),
        edge_types=list(obj.get("edge_types", [])),
        node_ids=list(obj.get("node_ids", [])),
        properties=dict(obj.get("properties", {})),
        match=match_from(obj.get("match")),
        edges=[edge_from(e) for e in obj.get("edges", [])],
        paths=[path_from(p) for p in obj.get("paths", [])],
        flow=flow_from(obj["flow"]) if obj.get("flow") else None,
        patterns=list(obj.get("patterns", [])),
        lens=list(obj.get("lens", [])),
        severity=list(obj.get("severity", [])),
        limit=obj.get("limit", DEFAULT_LIMIT),
        compact=bool(obj.get("compact_mode", False)),
        evidence_mode=obj.get("evidence_mode", "full"),
        explain=bool(obj.get("explain_mode", False)),
        include_evidence=bool(obj.get("include_evidence", True)),
        raw_text=raw,
    )
