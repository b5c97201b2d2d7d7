"""Runs plans and graph queries: everything becomes filters, semi joins and joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import NODE_COLUMNS, PropertyGraph
from loomgraph.operators import rules as R
from loomgraph.operators.traverse import Step, flow_paths, influencers, joined_pairs, many_to_many, with_bounded_path, with_edge, with_path
from loomgraph.plans import graphql as G
from loomgraph.plans.plan import EdgeSpec, FlowSpec, PathSpec, Plan, apply_hints
from loomgraph.plans.text import parse
from loomgraph.predicates import Both, Condition, Either, Not, compile_tree, condition, match


@dataclass
class Result:
    """nodes, edges and findings; those that a query doesn't make are None."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    findings: DataFrame | None = None
    paths: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    error: str | None = None


def step(spec: EdgeSpec) -> Step:
    return Step(spec.type, spec.direction, spec.target_type)


def require_edge(nodes: DataFrame, graph: PropertyGraph, spec: EdgeSpec) -> DataFrame:
    where = None
    if spec.target_match is not None:
        where = match(spec.target_match, graph.properties(*([spec.target_type] if spec.target_type else [])) | set(NODE_COLUMNS))
    return with_edge(nodes, graph, step(spec), where)


def require_path(nodes: DataFrame, graph: PropertyGraph, spec: PathSpec) -> DataFrame:
    if spec.source is not None:
        nodes = nodes.where(match(spec.source, nodes.columns))
    if spec.source_type:
        nodes = nodes.where(F.col("type") == spec.source_type)
    if spec.steps:
        return with_path(nodes, graph, [step(s) for s in spec.steps])
    return with_bounded_path(nodes, graph, spec.edge_types, spec.max_depth, spec.target_type, None, spec.direction)


def shaped(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Limit (by id, so that the set is stable), compact mode and evidence."""
    if plan.limit is not None:
        nodes = nodes.orderBy("id").limit(plan.limit)
    if plan.compact:
        return nodes.select(*NODE_COLUMNS)
    if not plan.include_evidence or plan.evidence_mode == "none":
        nodes = nodes.drop("evidence")
    return nodes


def run_plan(plan: Plan, graph: PropertyGraph, rules: list[R.Rule] | None = None) -> Result:
    if plan.error:
        return Result(warnings=plan.warnings, hints=plan.hints, error=plan.error)
    apply_hints(plan, graph.properties() | set(NODE_COLUMNS))
    told = {"warnings": plan.warnings, "hints": plan.hints}
    if plan.kind == "edges":
        edges = graph.edges(*plan.edge_types)
        return Result(edges=edges.orderBy("id").limit(plan.limit) if plan.limit is not None else edges, **told)
    if plan.kind == "flow" and plan.flow:
        return Result(paths=run_flow(plan.flow, graph), **told)
    if plan.kind == "pattern" or plan.patterns or plan.lens:
        chosen = R.select_rules(rules or [], plan.patterns, plan.lens, plan.severity)
        findings = R.run_rules(graph, chosen, explain=plan.explain)
        return Result(findings=findings.orderBy("pattern_id", "node_id").limit(plan.limit) if plan.limit is not None else findings, **told)
    nodes = graph.nodes(*plan.node_types)
    if plan.node_ids:
        nodes = graph.node_ids(plan.node_ids)
    known = nodes.columns
    where = plan.where if plan.where is not None else plan.match
    if where is not None:
        nodes = nodes.where(compile_tree(where, known))
    if plan.match is None and plan.properties:
        nodes = nodes.where(compile_tree(Both(tuple(Condition(k, "eq", v) for k, v in plan.properties.items())), known))
    for e in plan.edges:
        nodes = require_edge(nodes, graph, e)
    for p in plan.paths:
        nodes = require_path(nodes, graph, p)
    return Result(nodes=shaped(nodes, plan), **told)


def query(text: str, graph: PropertyGraph, rules: list[R.Rule] | None = None, limit: int | None = -1) -> Result:
    """A text in any of the languages; those of graph queries begin with capitals FIND with
    more than a plain WHERE, MATCH, FLOW, WITH or DESCRIBE."""
    types = {t.lower(): t for t in graph.node_tables} | {t.lower() + "s": t for t in graph.node_tables}
    head = text.split(None, 1)[0] if text.split() else ""
    if head in ("MATCH", "FLOW", "WITH", "DESCRIBE", "FIND"):
        try:
            found = run_graph_query(G.parse_graph_query(text, types), graph, {}, rules)
        except ValueError as e:
            return Result(error=str(e))
        return Result(nodes=found)
    plan = parse(text, types)
    return run_plan(plan if limit == -1 else replace(plan, limit=limit), graph, rules)


# The graph query language


def _ends(graph: PropertyGraph, type_: str | None, where: Any) -> DataFrame:
    nodes = graph.nodes(type_) if type_ else graph.nodes()
    return nodes if where is None else nodes.where(compile_tree(where, nodes.columns))


def run_flow(spec: FlowSpec, graph: PropertyGraph) -> DataFrame:
    """(source, target, depth, path), or (id, depth) of influencers; excluded sources
    are those whose label or kind is named; unsafe paths pass no sanitiser."""
    sources = _ends(graph, spec.from_type, spec.from_where)
    if spec.from_kinds and "kind" in sources.columns:
        sources = sources.where(F.col("kind").isin(list(spec.from_kinds)))
    if spec.exclude_sources:
        names = list(spec.exclude_sources)
        out = F.coalesce(F.col("label").isin(names), F.lit(False)) | (F.coalesce(F.col("kind").isin(names), F.lit(False)) if "kind" in sources.columns else F.lit(False))
        sources = sources.where(~out)
    targets = _ends(graph, spec.to_type, spec.to_where)
    blocked = None
    if spec.unsafe_only and "is_sanitizer" in graph.properties():
        blocked = graph.nodes().where(condition(Condition("is_sanitizer"))).select("id")
    if spec.direction == "in":
        return flow_paths(graph, targets, sources, spec.edge_types, spec.max_depth, "in", blocked)
    return flow_paths(graph, sources, targets, spec.edge_types, spec.max_depth, "out", blocked)


def _scoped(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{name}__{c}") for c in nodes.columns))


def _column(ref: str, default: str | None = None) -> str:
    """a.p is the column a__p; a alone its id."""
    if "." in ref:
        name, prop = ref.split(".", 1)
        return f"{name}__{prop}"
    return ref if default is None else f"{ref}__{default}"


def _bound(tree: Any) -> Any:
    """Conditions over names rewritten to the columns of bindings."""
    if isinstance(tree, Condition):
        if isinstance(tree.value, G.Property):
            other, own = F.col(_column(tree.value.name)), F.col(_column(tree.property))
            return F.coalesce({"eq": own == other, "neq": own != other, "gt": own > other, "gte": own >= other, "lt": own < other, "lte": own <= other}[tree.op], F.lit(False))
        return replace(tree, property=_column(tree.property))
    if isinstance(tree, (Both, Either)):
        return type(tree)(tuple(map(_bound, tree.items)))
    return Not(_bound(tree.item)) if isinstance(tree, Not) else tree


def _split(tree: Any) -> tuple[list, list]:
    """(conditions on columns, patterns that must or must not exist) of a conjunction."""
    items = tree.items if isinstance(tree, Both) else (() if tree is None else (tree,))
    patterns = [x for x in items if isinstance(x, G.Exists) or isinstance(x, Not) and isinstance(x.item, G.Exists)]
    return [x for x in items if x not in patterns], patterns


def _pattern_nodes(graph: PropertyGraph, node: G.NodePattern) -> DataFrame:
    nodes = graph.nodes(node.type) if node.type else graph.nodes()
    for cond in node.properties:
        nodes = nodes.where(compile_tree(cond, nodes.columns))
    return nodes


def _hop(graph: PropertyGraph, edge: G.EdgePattern, left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, target) pairs that the edge pattern joins, from ids of left to ids of right."""
    links = graph.edges(*edge.types, direction=edge.direction).select("source", "target")
    return links if (edge.least, edge.most) == (1, 1) else joined_pairs(links, left, right, edge.least, edge.most)


def _bind(graph: PropertyGraph, chain: G.Chain, bound: DataFrame | None, names: dict[str, set], rows: bool = True) -> tuple[DataFrame, dict[str, set]]:
    """Joins a chain onto bindings; its first name may be bound already. names: for each
    name the edges (type, direction) that it was reached by."""
    fresh = iter(f"_{k}" for k in range(len(chain.nodes)))
    labels = [n.name or next(fresh) for n in chain.nodes]
    names = {x: set(reached) for x, reached in names.items()}
    own = bound
    if labels[0] not in names:
        first = _scoped(_pattern_nodes(graph, chain.nodes[0]), labels[0])
        if own is not None:
            raise ValueError(f"the pattern of {labels[0]} shares no name with the one before")
        own = first
    for k, edge in enumerate(chain.edges):
        at, to = f"{labels[k]}__id", f"{labels[k + 1]}__id"
        node = _scoped(_pattern_nodes(graph, chain.nodes[k + 1]), labels[k + 1])
        hop = _hop(graph, edge, own.select(F.col(at).alias("id")), node.select(F.col(to).alias("id")))
        back = "in" if edge.direction == "out" else "out"
        if {(t, back) for t in edge.types} & names.get(labels[k], set()):
            # back over the edges that led here: as many rows on the one side as on the other
            own = many_to_many(own, hop.join(node, F.col("target") == F.col(to)).drop("target"), [(at, "source")]).drop("source")
        else:
            own = own.join(hop, F.col(at) == F.col("source")).join(node, F.col("target") == F.col(to)).drop("source", "target")
        names.setdefault(labels[k + 1], set()).update((t, edge.direction) for t in edge.types)
    return own, names | {x: names.get(x, set()) for x in labels}


def _exists(df: DataFrame, graph: PropertyGraph, item: Any, names: set[str]) -> DataFrame:
    """Semi (or anti) join on the chain's bound first name."""
    negate, ex = isinstance(item, Not), item.item if isinstance(item, Not) else item
    first = ex.chain.nodes[0].name
    if first not in names:
        raise ValueError(f"{first} is not bound by MATCH or FIND")
    inner, _ = _bind(graph, replace(ex.chain, nodes=(replace(ex.chain.nodes[0], name="__x"), *ex.chain.nodes[1:])), None, {})
    if ex.where is not None:
        inner = inner.where(compile_tree(_bound(ex.where), inner.columns))
    keys = inner.select(F.col("__x__id").alias("__k"))
    own = F.col(f"{first}__id") if f"{first}__id" in df.columns else F.col("id")
    return df.join(keys, own == F.col("__k"), "left_anti" if negate else "left_semi")


def _run_match(q: G.MatchQuery, graph: PropertyGraph) -> DataFrame:
    plain, patterns = _split(q.where)
    df, names = None, {}
    for chain in q.chains:
        first = chain.nodes[0].name
        if df is not None and first not in names and not chain.edges:
            df, names = _shared(df, graph, chain, plain, names)
            continue
        df, names = _bind(graph, chain, df, names)
    for item in plain:
        df = df.where(compile_tree(_bound(item), df.columns))
    for item in patterns:
        df = _exists(df, graph, item, names)
    return _returned(df, q.returns, q.limit, sorted(n for n in names if not n.startswith("_")))


def _shared(df: DataFrame, graph: PropertyGraph, chain: G.Chain, plain: list, names: dict[str, set]) -> tuple[DataFrame, dict[str, set]]:
    """A comma pattern: joined on the equalities that WHERE gives; a product of all rows is refused."""
    name = chain.nodes[0].name
    other = _scoped(_pattern_nodes(graph, chain.nodes[0]), name)
    keys = []
    for c in plain:
        if isinstance(c, Condition) and isinstance(c.value, G.Property) and c.op == "eq":
            sides = {c.property.split(".")[0], c.value.name.split(".")[0]}
            if name in sides and sides - {name} <= set(names):
                keys.append(F.col(_column(c.property)) == F.col(_column(c.value.name)))
    if not keys:
        raise ValueError(f"({name}) needs an equality with a name before it: a product of all rows is not run")
    return df.join(other, keys), names | {name: set()}


def _returned(df: DataFrame, returns: list[str], limit: int | None, names: list[str]) -> DataFrame:
    if returns and returns != ["*"]:
        out = []
        for r in returns:
            if "." in r:
                out.append(F.col(_column(r)).alias(r.replace(".", "_")))
            elif f"{r}__id" in df.columns:
                out += [F.col(f"{r}__{c}").alias(f"{r}_{c}") for c in NODE_COLUMNS]
            else:
                out.append(F.col(r))
        df = df.select(*out)
    elif names:
        df = df.select(*(F.col(f"{n}__{c}").alias(f"{n}_{c}") for n in names for c in NODE_COLUMNS))
    return df if limit is None else df.orderBy(*df.columns).limit(limit)


def run_graph_query(q: Any, graph: PropertyGraph, named: dict[str, DataFrame], rules: list[R.Rule] | None = None) -> DataFrame:
    if isinstance(q, G.With):
        return run_graph_query(q.body, graph, named | {q.name: run_graph_query(q.query, graph, named, rules)}, rules)
    if isinstance(q, G.Describe):
        return describe(q, graph, rules or [])
    if isinstance(q, G.Flow):
        if q.returns == "INFLUENCERS":
            ends = _ends(graph, q.spec.to_type, q.spec.to_where)
            return influencers(graph, ends, q.spec.edge_types, q.spec.max_depth)
        return run_flow(q.spec, graph)
    if isinstance(q, G.MatchQuery):
        return _run_match(q, graph)
    nodes = graph.nodes(q.type)
    if q.within is not None:
        if q.within not in named:
            raise ValueError(f"{q.within} is not defined by WITH")
        nodes = nodes.join(named[q.within].select(F.col("id").alias("__k")), F.col("id") == F.col("__k"), "left_semi")
    plain, patterns = _split(q.where)
    for item in plain:
        nodes = nodes.where(compile_tree(item, nodes.columns))
    for item in patterns:
        chain = item.item.chain if isinstance(item, Not) else item.chain
        nodes = _exists(nodes, graph, item, {chain.nodes[0].name})
    nodes = nodes if q.limit is None else nodes.orderBy("id").limit(q.limit)
    return nodes if not q.returns or "*" in q.returns else nodes.select(*q.returns)


def describe(q: G.Describe, graph: PropertyGraph, rules: list[R.Rule]) -> DataFrame:
    """A table of names: types and edges that have rows, declared properties, rule ids."""
    spark = next(iter(graph.node_tables.values())).sparkSession
    if q.what == "TYPES":
        return graph.nodes().select(F.col("type").alias("name")).distinct()
    if q.what == "EDGES":
        return graph.edges().select(F.col("type").alias("name")).distinct()
    names = sorted(r.id for r in rules) if q.what == "PATTERNS" else sorted(graph.properties(*([q.type] if q.type else [])))
    return spark.createDataFrame([(n,) for n in names], "name string")


def schema_snapshot(graph: PropertyGraph, rules: list[R.Rule]) -> dict[str, list[str]]:
    """What a client may ask for; the types are those declared, so no data is read."""
    from loomgraph.plans.text import EDGE_PHRASES, NODE_PHRASES, PROPERTY_PHRASES
    from loomgraph.predicates import OPERATORS

    return {
        "properties": sorted(graph.properties() | {c.property for r in rules for c in r.conditions()}),
        "node_types": sorted(graph.node_tables),
        "edge_types": sorted(graph.edge_tables),
        "pattern_ids": sorted(r.id for r in rules),
        "lenses": sorted({x for r in rules for x in r.lens}),
        "operators": sorted(OPERATORS),
        "phrases": sorted({*PROPERTY_PHRASES, *NODE_PHRASES, *EDGE_PHRASES}),
    }
