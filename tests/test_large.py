"""Steps whose faults show on large tables, made small."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.model import PropertyGraph
from loomgraph.operators import dedup, rules
from loomgraph.operators import traverse as T
from loomgraph.plans import run
from loomgraph.scratch import work
from tests.conftest import SMALL, rows


def plan_of(df) -> str:
    """The plan as it ran."""
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lens_report_counts_owners_of_several_parts_once(spark, duck, monkeypatch):
    """an owner with more findings than a part holds has one row."""
    queries, sql = catalog.load()
    monkeypatch.setattr(rules, "lens_report", partial(rules.lens_report, part_rows=2))
    assert rows(queries["lens_report"](spark, SMALL).toPandas()) == rows(duck.execute(sql["lens_report"]).df())


def test_names_are_not_broadcast_to_resolve_rules(spark):
    """only rules are sent to all executors, by way of the driver."""
    names = spark.range(2000).selectExpr("id", "concat('a.b', id) as check_id")
    known = spark.createDataFrame([("7",), ("b17",), (None,), ("",), ("7",)], "id string")
    got = dedup.resolve_rule(names, known)
    plan = plan_of(got)
    assert "SortMergeJoin [check_id" in plan and "BroadcastHashJoin [check_id" not in plan
    told = {r["check_id"]: r["rule_id"] for r in got.collect()}
    assert len(told) == 2000 and told["a.b17"] == "b17" and told["a.b27"] == "7" and told["a.b28"] == "b28"


@pytest.mark.parametrize("size", [4096, 5])
def test_pairs_of_large_keys_are_dealt_to_many_tasks(spark, size):
    """a key's pairs are blocks against blocks; all of them are made, none twice."""
    left = spark.range(40).selectExpr("id as a_id", "if(id < 30, 'x', if(id < 35, 'y', null)) as a_k")
    right = spark.range(25).selectExpr("id as b_id", "if(id < 20, 'x', 'z') as b_k")
    got = T.many_to_many(left, right, [("a_k", "b_k")], size)
    assert got.columns == ["a_id", "a_k", "b_id", "b_k"]
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == [(a, b) for a in range(30) for b in range(20)]
    part = spark.range(600).selectExpr("id", "id % 2 as k")
    pairs = T.paired(part, part, ["k"])
    tasks = pairs.rdd.glom().map(len).collect()
    assert sum(tasks) == 2 * 300 * 299 and sum(n > 0 for n in tasks) > 1


def test_patterns_that_fold_back_join_nodes_before_pairs(spark):
    """edges of other kinds into a shared node make no rows."""
    nodes = spark.createDataFrame([*((f"s{k}", "S", f"S{k}") for k in range(6)), *((f"c{k}", "C", f"C{k}") for k in range(50)), ("n0", "N", "N0"), ("n1", "N", "N1")], "id string, type string, label string")
    edges = spark.createDataFrame([(f"{t}{k}>", "IN", f"{t}{k}", f"n{k % 2}") for t, n in (("s", 6), ("c", 50)) for k in range(n)], "id string, type string, source string, target string")
    graph = PropertyGraph.from_frames(nodes, edges, ["S", "C", "N"], ["IN"])
    got = run.query("MATCH (a:S)-[:IN]->(n:N), (n)<-[:IN]-(b:S) WHERE a.id != b.id RETURN a.label, b.label", graph).nodes
    assert sorted(map(tuple, got.collect())) == sorted((f"S{a}", f"S{b}") for a in range(6) for b in range(6) if a != b and a % 2 == b % 2)
    assert "__pack" in plan_of(got)
    one = run.query("MATCH (a:S)-[:IN]->(n:N)<-[:IN]-(c:C) WHERE a.label = 'S1' RETURN c.id", graph).nodes
    assert sorted(r[0] for r in one.collect()) == sorted(f"c{k}" for k in range(50) if k % 2)


@pytest.mark.parametrize("few", ["sources", "targets"])
def test_flows_only_take_edges_around_the_fewer_ends(spark, few):
    """what is blocked is looked for among the edges in reach only."""
    nodes = [*((f"a{k}", "A") for k in range(9)), *((f"b{k}", "B") for k in range(9)), *((f"c{k}", "C") for k in range(9))]
    edges = [*((f"a{k}", f"b{j}") for k in range(9) for j in range(9) if (k + j) % 3), *((f"b{k}", f"c{j}") for k in range(9) for j in range(9) if (k * j) % 4 == 1), ("c1", "a1"), ("b1", "b5")]
    n = spark.createDataFrame([(i, t, i) for i, t in nodes], "id string, type string, label string")
    e = spark.createDataFrame([(f"{s}>{t}", "E", s, t) for s, t in [*edges, edges[0]]], "id string, type string, source string, target string")
    graph = PropertyGraph.from_frames(n, e, ["A", "B", "C"], ["E"])
    src, dst = (["a1"], [f"c{k}" for k in range(9)]) if few == "sources" else ([f"a{k}" for k in range(9)], ["c1"])
    blocked = {"b5", "a7"}
    want, walks = set(), [(s,) for s in src]
    for _ in range(4):
        walks = [(*w, t) for w in walks for s, t in set(edges) if s == w[-1] and t not in w and t not in blocked]
        want |= {w for w in walks if w[-1] in dst}
    pick = lambda ids: n.where(F.col("id").isin(list(ids)))
    got = T.flow_paths(graph, pick(src), pick(dst), ("E",), 4, "out", pick(blocked)).collect()
    assert len(got) == len(want) and {tuple(r["path"]) for r in got} == want and all(r["depth"] == len(r["path"]) - 1 for r in got)
    with work() as made:
        links = graph.edges("E").select("source", "target")
        around = {tuple(r) for r in T._around(links, pick(src), pick(dst), 1, made, pick(blocked)).collect()}
    assert around == {(s, t) for s, t in edges if t not in blocked and (s in src if few == "sources" else t in dst)}


def test_sets_that_share_too_little_do_not_meet(spark):
    """pairs that share one item of many are not candidates."""
    sets = [(k, [0, *range(10 * k + 1, 10 * k + 6)]) for k in range(40)] + [(100, [0, 1, 2, 3, 4]), (101, [0]), (102, [0, 0])]
    df = spark.createDataFrame(sets, "id long, x array<long>")
    got = dedup.jaccard_pairs(df, "id", "x", 0.5)
    own = {k: set(x) for k, x in sets}
    alike = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b and len(own[a] & own[b]) * 2 >= len(own[a] | own[b])}
    assert {(r["a"], r["b"]): r["jaccard"] for r in got.collect()} == alike
    assert "bit_count" in plan_of(got)
