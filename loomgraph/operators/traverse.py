"""Graph traversal as joins: edges, fixed paths, bounded paths, flows, PageRank.

Existence queries walk back from the targets with distinct frontiers and end in
one semi join, so what shuffles is ids, never rows times paths. A walk of more
than one edge writes each frontier to the shared folder, so that the plan of a
depth reads the one before it and does not hold it. Only queries that return
paths carry arrays, and only along edges that can still reach a target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.scratch import table, work

#: Rows of a key that one side brings to a block of a many-to-many join.
BLOCK = 4096


@dataclass(frozen=True)
class Step:
    edge_type: str | tuple[str, ...]
    direction: str = "out"
    target_type: str | None = None

    @property
    def edge_types(self) -> tuple[str, ...]:
        return (self.edge_type,) if isinstance(self.edge_type, str) else tuple(self.edge_type)


def _targets(graph: PropertyGraph, type_: str | None, where: Column | None) -> DataFrame | None:
    if type_ is None and where is None:
        return None
    nodes = graph.nodes(type_) if type_ else graph.nodes()
    return (nodes.where(where) if where is not None else nodes).select(F.col("id").alias("target"))


def _links(graph: PropertyGraph, step: Step, targets: DataFrame | None) -> DataFrame:
    links = graph.edges(*step.edge_types, direction=step.direction).select("source", "target")
    return links if targets is None else links.join(targets, "target", "left_semi")


def with_edge(nodes: DataFrame, graph: PropertyGraph, step: Step, target_where: Column | None = None, negate: bool = False) -> DataFrame:
    """Nodes that have (or lack) an edge of the step's kind to a matching target."""
    found = _links(graph, step, _targets(graph, step.target_type, target_where)).select(F.col("source").alias("__s"))
    return nodes.join(found, F.col("id") == F.col("__s"), "left_anti" if negate else "left_semi")


def with_path(nodes: DataFrame, graph: PropertyGraph, steps: list[Step], last_where: Column | None = None) -> DataFrame:
    """Nodes from which the steps can be walked in order."""
    front: DataFrame | None = None
    for k, step in reversed(list(enumerate(steps))):
        targets = _targets(graph, step.target_type, last_where if k == len(steps) - 1 else None)
        if front is not None:
            targets = front if targets is None else targets.join(front, "target", "left_semi")
        front = _links(graph, step, targets).select(F.col("source").alias("target")).distinct()
    return nodes if front is None else nodes.join(front.withColumnRenamed("target", "__s"), F.col("id") == F.col("__s"), "left_semi")


def reachable(graph: PropertyGraph, seeds: DataFrame, edge_types: tuple[str, ...], max_depth: int, direction: str = "out", min_depth: int = 1) -> DataFrame:
    """(id, depth): nodes at the end of a walk of min_depth to max_depth edges from
    any seed (a table of id), with the least such depth."""
    links = graph.edges(*edge_types, direction=direction).select("source", "target")
    front = seeds.select(F.col("id").alias("source"))
    found: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        front = links.join(front, "source", "left_semi").select(F.col("target").alias("source")).distinct()
        if found is not None and min_depth == 1:
            # what an earlier depth has reached leads nowhere new
            front = front.join(found.select(F.col("id").alias("source")), "source", "left_anti")
        if max_depth > 1:
            front = table(front, "front")
        if depth >= min_depth:
            layer = front.select(F.col("source").alias("id"), F.lit(depth).alias("depth"))
            if found is None:
                found = layer
            else:
                found = found.unionByName(layer if min_depth == 1 else table(layer.join(found.select("id"), "id", "left_anti"), "layer"))
        if depth < max_depth and front.isEmpty():
            break
    return front.select(F.col("source").alias("id"), F.lit(0).alias("depth")).where(F.lit(False)) if found is None else found


def _around(links: DataFrame, seeds: DataFrame, ends: DataFrame, most: int, made: list, blocked: DataFrame | None = None) -> DataFrame:
    """The distinct edges, but those into blocked nodes, that are within `most` edges of
    the seeds, or of the ends where these are fewer: every walk from a seed to an end
    keeps to them. Each node's edges are taken once; all edges are read once a depth and
    only move if the nodes they meet are many."""
    seeds, ends = (table(x.select("id").distinct(), "ends", made) for x in (seeds, ends))
    near, far, front = ("source", "target", seeds) if seeds.count() <= ends.count() else ("target", "source", ends)
    front, seen, out = front.withColumnRenamed("id", near), None, None
    for depth in range(1, most + 1):
        own = table(links.join(front, near, "left_semi").select("source", "target").distinct(), "around", made)
        if blocked is not None:
            hit = blocked.join(own.select(F.col("target").alias("__t")).distinct(), F.col("id") == F.col("__t"), "left_semi").select(F.col("id").alias("target"))
            own = table(own.join(table(hit.distinct(), "blocked", made), "target", "left_anti").select("source", "target"), "around", made)
        out = own if out is None else out.unionByName(own)
        if depth == most:
            break
        seen = front if seen is None else seen.unionByName(front)
        front = table(own.select(F.col(far).alias(near)).distinct().join(seen, near, "left_anti"), "front", made)
        if front.isEmpty():
            break
    return out


def _within(links: DataFrame, ends: DataFrame, most: int, made: list) -> list[DataFrame]:
    """For k from 0 to most: the nodes (target) from which an end is at most k edges away."""
    out = [table(ends.select(F.col("id").alias("target")).distinct(), "within", made)]
    for _ in range(most):
        before = links.join(out[-1], "target", "left_semi").select(F.col("source").alias("target"))
        out.append(table(before.unionByName(out[-1]).distinct(), "within", made))
    return out


def joined_pairs(links: DataFrame, seeds: DataFrame, ends: DataFrame, least: int, most: int) -> DataFrame:
    """(source, target): a seed and an end that a walk of least to most edges joins.
    Walks start at the seeds and only take edges from which an end is in reach."""
    with work() as made:
        links = _around(links, seeds, ends, most, made)
        near = _within(links, ends, most - 1, made)
        walk = seeds.select(F.col("id").alias("source"), F.col("id").alias("at")).distinct()
        out: DataFrame | None = None
        for depth in range(1, most + 1):
            own = links.join(near[most - depth], "target", "left_semi").select(F.col("source").alias("at"), "target")
            walk = table(walk.join(own, "at").select("source", F.col("target").alias("at")).distinct(), "walk", made)
            if depth >= least:
                hit = walk.select("source", F.col("at").alias("target")).join(near[0], "target", "left_semi").select("source", "target")
                out = hit if out is None else out.unionByName(hit)
        return table(out.distinct(), "pairs")


def with_bounded_path(nodes: DataFrame, graph: PropertyGraph, edge_types: tuple[str, ...], max_depth: int, target_type: str | None = None, target_where: Column | None = None, direction: str = "out") -> DataFrame:
    """Nodes from which a matching target is at most max_depth edges away."""
    targets = _targets(graph, target_type, target_where)
    seeds = graph.nodes().select("id") if targets is None else targets.withColumnRenamed("target", "id")
    back = "in" if direction == "out" else "out"
    return nodes.join(reachable(graph, seeds, edge_types, max_depth, back).select(F.col("id").alias("__s")), F.col("id") == F.col("__s"), "left_semi")


def bindings(left: DataFrame, graph: PropertyGraph, step: Step, right: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """MATCH (a)-[:E]->(b): a row for each edge, columns prefixed a_ and b_."""
    links = graph.edges(*step.edge_types, direction=step.direction).select("source", "target")
    own = left.select(*(F.col(c).alias(f"{a}_{c}") for c in left.columns))
    other = right.select(*(F.col(c).alias(f"{b}_{c}") for c in right.columns))
    return own.join(links, F.col(f"{a}_id") == F.col("source")).join(other, F.col("target") == F.col(f"{b}_id")).drop("source", "target")


def many_to_many(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], rows: int = BLOCK) -> DataFrame:
    """An inner join on equal columns (of left, of right) whose keys have many rows on
    both sides. A key's rows are dealt to blocks of about `rows` on either side, and a
    block of the left meets one of the right in a task's turn, so that no task has more
    of a large key, and none holds more of it, than that. All pairs are made."""
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"__k{k}" for k in range(len(on))]
    # maps and variants have no hash
    hashed = lambda df: F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
    own, other = (df.select(*(F.col(c).alias(k) for c, k in zip(cols, keys, strict=True)), hashed(df).alias("__h"), F.struct(*df.columns).alias("__row")) for df, cols in ((left, [a for a, _ in on]), (right, [b for _, b in on])))
    sizes = [df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(n)) for df, n in ((own, "__ls"), (other, "__rs"))]
    sizes = sizes[0].join(sizes[1], keys)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod("__h", F.col(n)).cast("int")
    own = own.join(sizes, keys).select(*keys, "__row", dealt("__ls").alias("__l"), all_of("__rs").alias("__r"))
    packs = other.join(sizes, keys).groupBy(*keys, dealt("__rs").alias("__r"), "__ls").agg(F.collect_list("__row").alias("__pack"))
    packs = packs.select(*keys, "__r", "__pack", all_of("__ls").alias("__l"))
    # a number of its own keeps small tables with many pairs from being joined in one task
    at = [*keys, "__l", "__r"]
    met = own.repartition(parts, *at).join(packs.repartition(parts, *at), at).select("__row", F.explode("__pack").alias("__other"))
    return met.select(*(F.col(f"__row.`{c}`").alias(c) for c in left.columns), *(F.col(f"__other.`{c}`").alias(c) for c in right.columns))


def paired(left: DataFrame, right: DataFrame, on: list[str], differ: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """Comma patterns with an inequality. They are joined on shared keys: without
    any, the query is a product of all rows and is refused."""
    if not on:
        raise ValueError("a comma pattern needs a shared property: a product of all rows is not run")
    own = left.select(*(F.col(c).alias(f"{a}_{c}") for c in left.columns))
    other = right.select(*(F.col(c).alias(f"{b}_{c}") for c in right.columns))
    return many_to_many(own, other, [(f"{a}_{k}", f"{b}_{k}") for k in on]).where(F.col(f"{a}_{differ}") != F.col(f"{b}_{differ}"))


def flow_paths(graph: PropertyGraph, sources: DataFrame, targets: DataFrame, edge_types: tuple[str, ...], max_depth: int = 5, direction: str = "out", blocked: DataFrame | None = None) -> DataFrame:
    """(source, target, depth, path): simple paths from a source to a target that
    pass no blocked node. Paths grow one edge a step, so max_depth is a bound."""
    links = graph.edges(*edge_types, direction=direction).select("source", "target")
    with work() as made:
        links = _around(links, sources, targets, max_depth, made, blocked)
        near = _within(links, targets, max_depth - 1, made)
        walk = sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.array("id").alias("path"))
        out: DataFrame | None = None
        for depth in range(1, max_depth + 1):
            # only edges from which a target is still in reach
            own = links.join(near[max_depth - depth], "target", "left_semi")
            own = own.join(walk.select(F.col("target").alias("source")).distinct(), "source", "left_semi").distinct().select(F.col("source").alias("__from"), F.col("target").alias("__to"))
            walk = walk.join(own, F.col("target") == F.col("__from")).where(~F.array_contains("path", F.col("__to")))
            walk = table(walk.select("source", F.col("__to").alias("target"), F.concat("path", F.array("__to")).alias("path")), "walk", made if depth < max_depth else None)
            hit = walk.join(near[0], "target", "left_semi") if depth < max_depth else walk
            hit = hit.select("source", "target", F.lit(depth).alias("depth"), "path")
            if depth < max_depth:
                hit = table(hit, "hit")
            out = hit if out is None else out.unionByName(hit)
        return out


def influencers(graph: PropertyGraph, targets: DataFrame, edge_types: tuple[str, ...], max_depth: int = 5) -> DataFrame:
    """(id, depth): what reaches a target: a flow walked backward."""
    return reachable(graph, targets, edge_types, max_depth, "in")


def owners(members: DataFrame, contains: DataFrame) -> DataFrame:
    """members with owner: the source of the containing edge with the greatest id, or null."""
    one = contains.groupBy(F.col("target").alias("__m")).agg(F.max_by("source", "id").alias("owner"))
    return members.join(one, F.col("id") == F.col("__m"), "left").drop("__m")


# Edge weights for PageRank. Base weights by edge type, and what
# kinds of analysis change.
BASE_WEIGHTS = {
    "calls_external": 1.5,
    "delegatecall": 2.0,
    "writes_state": 1.3,
    "calls": 1.0,
    "reads_state": 0.8,
    "uses_variable": 0.7,
    "has_modifier": 0.5,
    "inherits": 0.6,
    "uses": 0.5,
    "emits_event": 0.4,
    "has_parameter": 0.5,
    "has_loop": 0.6,
    "contains": 0.4,
    "defines": 0.3,
}
ANALYSIS_WEIGHTS = {
    "reentrancy": {"calls_external": 2.0, "delegatecall": 2.5, "writes_state": 1.5},
    "access_control": {"has_modifier": 0.8, "calls_external": 1.2},
    "dos": {"has_loop": 1.5, "calls_external": 1.3},
    "oracle": {"reads_state": 1.3, "calls_external": 1.4},
}
DEFAULT_WEIGHT, TAINT_FACTOR, SOURCE_GUARD_FACTOR, GUARD_FACTOR, LEAST_WEIGHT = 0.5, 1.3, 0.6, 0.7, 0.01


def analysis_weights(kind: str | None = None) -> dict[str, float]:
    return BASE_WEIGHTS | ANALYSIS_WEIGHTS.get(kind or "", {})


def base_weight(edge_type: Column, weights: dict[str, float] | None = None) -> Column:
    table = BASE_WEIGHTS if weights is None else weights
    pairs = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(pairs, F.replace(F.lower(edge_type), F.lit("-"), F.lit("_"))), F.lit(DEFAULT_WEIGHT))


def edge_weights(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """edges with weight: base by type, raised by risk (to twice) and taint, lowered by guards."""
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in edges.columns else F.lit(default)
    tainted = has("is_tainted", False) | (F.col("taint_source").isNotNull() if "taint_source" in edges.columns else F.lit(False))
    guarded = has("has_guard", False) | has("is_guarded", False)
    guard = F.when(has("guards_at_source", False), SOURCE_GUARD_FACTOR).when(guarded, GUARD_FACTOR).otherwise(1.0)
    w = base_weight(F.col("type"), weights) * (1 + F.least(has("risk_score", 0.0), F.lit(1.0))) * F.when(tainted, TAINT_FACTOR).otherwise(1.0) * guard
    return edges.withColumn("weight", F.greatest(w, F.lit(LEAST_WEIGHT)))


def batch_weights(edges: DataFrame, order: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(edge_id, weight); an edge without an id is source->target, the last of an id counts."""
    named = edge_weights(edges, weights).withColumn("edge_id", F.coalesce("id", F.concat_ws("->", "source", "target")))
    return named.groupBy("edge_id").agg(F.max_by("weight", order).alias("weight"))


def normalised(edges: DataFrame) -> DataFrame:
    """edges with share: weight over all that leave the source. A missing weight is 1; a total of 0 is shared evenly."""
    own = Window.partitionBy("source")
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    total = F.sum(w).over(own)
    return edges.withColumn("share", F.when(total > 0, w / total).otherwise(1.0 / F.count("*").over(own)))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10, tolerance: float = 0.0) -> DataFrame:
    """(id, rank) by power iterations, until the ranks move by less than tolerance in
    all. edges: source, target, share (normalised); seeds: id. Rank that reaches a
    node without edges returns to the seeds. Sums are combined before the shuffle;
    each round is written, so a round's plan reads the one before it."""
    start = seeds.select("id").distinct()
    n = start.count()
    base = start.select("id", F.lit(1.0 / max(n, 1)).alias("r0"))
    with work() as made:
        links = table(edges.groupBy("source", "target").agg(F.sum("share").alias("share")), "links", made)
        rank = base.select("id", F.col("r0").alias("rank"))
        for k in range(1, iterations + 1):
            moved = links.join(rank, F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
            moved = table(moved, "moved", made)
            kept = moved.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("kept")).first()["kept"]
            back = base.select("id", (F.col("r0") * (1 - kept)).alias("rank"))
            after = table(moved.unionByName(back).groupBy("id").agg(F.sum("rank").alias("rank")), "rank")
            if tolerance > 0 and k < iterations:
                old = rank.select(F.col("id").alias("__i"), F.col("rank").alias("__r"))
                change = after.join(old, F.col("id") == F.col("__i"), "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("__r", F.lit(0.0)))).alias("c")).first()["c"]
                if (change or 0.0) < tolerance:
                    return after
            rank = after
        return rank


def ranked_subgraph(graph: PropertyGraph, rank: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least that rank, and the edges between them."""
    ids = rank.where(F.col("rank") >= least).select(F.col("id").alias("__k"))
    nodes = graph.nodes().join(ids, F.col("id") == F.col("__k"), "left_semi")
    edges = graph.edges().join(ids, F.col("source") == F.col("__k"), "left_semi").join(ids, F.col("target") == F.col("__k"), "left_semi")
    return nodes, edges
