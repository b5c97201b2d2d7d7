"""Cases of the newer operators that the sample tables do not hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.cache import ResultCache
from loomgraph.functions import encode
from loomgraph.operators import dedup, evaluate, overlay, risk, rules, scores
from loomgraph.sources import files
from loomgraph.streaming import monitor


def test_matching_takes_free_second_choices(spark):
    f = spark.createDataFrame([(1, "a", 10), (2, "a", 12), (3, "b", 5), (4, "a", 400)], "id long, f string, line int")
    t = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, None, 5)], "id long, f string, line int")
    got = sorted(tuple(r) for r in evaluate.match_truth(f, t, ["f"], "line").collect())
    assert got == [(1, 1, 0), (2, 2, 8)]


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_what_going_through_all_pairs_gives(spark, seed):
    r = random.Random(seed)
    f = [(k, r.choice("ab"), r.randint(0, 60)) for k in range(25)]
    t = [(k, r.choice("ab"), r.randint(0, 60)) for k in range(25)]
    pairs = sorted((abs(x[2] - y[2]), x[0], y[0]) for x in f for y in t if x[1] == y[1] and abs(x[2] - y[2]) <= 10)
    want, a, b = [], set(), set()
    for d, x, y in pairs:
        if x not in a and y not in b:
            want.append((x, y, d))
            a.add(x)
            b.add(y)
    schema = "id long, f string, line int"
    got = evaluate.match_truth(spark.createDataFrame(f, schema), spark.createDataFrame(t, schema), ["f"], "line").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_cooldown_holds_across_days(spark):
    at = dt.datetime(2024, 1, 1)
    times = [0, 10, 86_399, 86_401, 86_402, 200_000, 286_400, 286_399]
    rows = [("k", at + dt.timedelta(seconds=s)) for s in times] + [("j", at), ("k", None)]
    got = monitor.cooled(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 86_400).collect()
    out = sorted((r["k"], int(r["ts"].timestamp() - at.replace(tzinfo=None).timestamp()), r["alerts"]) for r in got)
    assert [(k, n) for k, _, n in out] == [("j", 1), ("k", 3), ("k", 2), ("k", 2), ("k", 1)]
    gaps = [s for k, s, _ in out if k == "k"]
    assert all(b - a >= 86_400 for a, b in zip(gaps, gaps[1:], strict=False))


def test_moving_average_is_the_recurrence(spark):
    r = random.Random(1)
    rows = [(k, j, r.random() * 100) for k, n in ((0, 1), (1, 2), (2, 50), (3, 300)) for j in range(n)]
    got = {x["k"]: x["ema"] for x in scores.ema(spark.createDataFrame(rows, "k int, j int, v double"), "k", "j", "v").collect()}
    for k in got:
        own = [v for a, _, v in rows if a == k]
        want = own[0]
        for v in own[1:]:
            want = want * 0.7 + v * 0.3
        assert abs(got[k] - want) < 1e-9


def test_large_packs_and_reports_have_parts(spark):
    items = spark.createDataFrame([("s", "t", f"n{k:02}", "x" * 30) for k in range(10)], "src string, type string, name string, content string")
    parts = sorted(overlay.context_pack(items, by="src", most_bytes=100).collect(), key=lambda r: r["part"])
    assert [r["items"] for r in parts] == [4, 3, 3] and sum(r["bytes"] for r in parts) == 300
    found = spark.createDataFrame([("p", f"n{k}", "low", ["A"]) for k in range(50)], "pattern_id string, node_id string, severity string, lens array<string>")
    owner = spark.createDataFrame([("n1", "x")], "node_id string, owner string")
    got = rules.lens_report(found, owner, ["A"], part_rows=10).collect()
    assert sum(len(r["findings"]) for r in got) == 50 and {(r["owner"], r["A"], r["total"]) for r in got} == {("x", 1, 1), ("unknown", 49, 49)}
    assert len(got) > 3


@pytest.mark.parametrize("rows", [1024, 7])
def test_alike_compares_all_pairs_of_a_block(spark, rows):
    r = random.Random(2)
    v = [(k, [r.gauss(0, 1) for _ in range(3)], "ab"[k % 2] if k % 9 else None) for k in range(60)] + [(100, None, "a"), (101, [0.0, 0.0, 0.0], "a"), (None, [1.0, 0.0, 0.0], "a")]
    df = spark.createDataFrame(v, "id long, v array<double>, g string")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    want = {(i, j) for i, x, g in v[:60] for j, y, h in v[:60] if i < j and g == h and dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 > 0.9}
    assert {(x["a"], x["b"]) for x in dedup.alike(df, "id", "v", "g", 0.9, rows).collect()} == want
    clusters = {x["id"]: x["cluster"] for x in dedup.embedding_clusters(df.where("id is not null"), "id", "v", "g", 0.9).collect()}
    assert all(clusters[i] == clusters[j] for i, j in want) and clusters[100] == 100


def test_hook_fields_are_read_in_order_where_they_are(spark):
    lean = spark.createDataFrame([("s", ("u", "q1")), ("", ("", "q2")), (None, ("w", None))], "session_id string, data struct<tool_use_id:string,query:string>")
    got = sorted((r["run_id"], r["queries"], r["tools"], r["response"]) for r in files.evaluation_inputs(lean).collect())
    assert got == [("s:u", ["q1"], [], ""), ("w", [], [], "")]
    rich = spark.createDataFrame([("s", "u", "graph_query", "", "top", ("", "inner"))], "session_id string, tool_use_id string, event_type string, raw_observation string, output string, data struct<raw_observation:string,response_text:string>")
    one = files.evaluation_inputs(rich).first()
    assert one["response"] == "inner" and one["tools"] == ["Bash"]


def test_results_are_kept_for_their_time(spark):
    now = [0.0]
    cache = ResultCache(ttl=10, most=2, clock=lambda: now[0])
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert cache.get("g", "find  x", make).count() == 3 and cache.get("g", "find x", make).count() == 3
    assert (len(made), cache.hits, cache.misses) == (1, 1, 1)
    cache.get("h", "find x", make)
    cache.get("g", "find y", make)
    assert len(cache.held) == 2
    now[0] = 11
    cache.expire()
    assert not cache.held
    cache.get("g", "find x", make)
    cache.clear()
    assert not cache.held and len(made) == 4


def test_game_values(spark):
    got = spark.range(1).select(*(risk.mixed_equilibrium(*map(F.lit, g)).alias(n) for n, g in (("pennies", (1.0, -1.0, -1.0, 1.0)), ("saddle", (3.0, 2.0, 1.0, 0.0)), ("other", (0.0, 1.0, 2.0, 3.0))))).first()
    assert (got["pennies"], got["saddle"], got["other"]) == (0.5, 1.0, 0.0)
    chances = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.0), ("b", 0.2), ("c", 0.0)], "k string, p double")
    assert {r["k"]: round(r["x"], 9) for r in chances.groupBy("k").agg(risk.any_of(F.col("p")).alias("x")).collect()} == {"a": 0.75, "b": 1.0, "c": 0.0}


def test_detail_holds_at_every_depth(spark):
    df = spark.sql("select 1 as id, 'n' as name, named_struct('id', 2, 'raw', 'r', 'in', named_struct('raw', 1)) as meta, named_struct('raw', 5) as gone")
    assert encode.detail(df, "DETAILED", [], ["raw"]).schema.simpleString() == "struct<id:int,name:string,meta:struct<id:int>>"
    assert encode.detail(df, "SUMMARY", ["id", "meta"], []).schema.simpleString() == "struct<id:int,meta:struct<id:int>>"
    assert encode.detail(df, "FULL", [], []).columns == df.columns


def test_label_coverage_names_what_is_undecided(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    labels = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), ("b", "X")], "function_id string, label_id string")
    got = {r["id"]: (r["held"], r["coverage"]) for r in rules.label_coverage(nodes, ("X", "Y"), labels).collect()}
    assert got == {"a": (2, "decided"), "b": (1, "unknown"), "c": (0, "skippable")}
