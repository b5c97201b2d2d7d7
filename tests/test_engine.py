"""Plans, predicates, rules, traversal, sources and streams on small graphs."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import confidence, costs, encode, labels, metrics, names
from loomgraph.model import PropertyGraph
from loomgraph.operators import dedup, evaluate, overlay, rules, scores, traverse
from loomgraph.plans import run
from loomgraph.plans.graphql import parse_graph_query
from loomgraph.plans.plan import EdgeSpec, PathSpec, Plan, apply_hints
from loomgraph.plans.text import parse
from loomgraph.plans.tokens import ParseError
from loomgraph.predicates import Both, Condition, Either, Match, Not, clause_status, compile_tree
from loomgraph.sources import files
from loomgraph.streaming import monitor


@pytest.fixture(scope="module")
def graph(spark):
    """Two contracts; f1 calls out, f2 is guarded, f3 is reached over two calls."""
    fn = "id string, type string, label string, visibility string, writes_state boolean, has_access_gate boolean, operations array<string>, behavioral_signature string, kind string"
    functions = spark.createDataFrame(
        [
            ("f1", "Function", "withdraw", "public", True, False, ["READS", "CALLS", "WRITES"], "R:bal→X:out→W:bal", "parameter"),
            ("f2", "Function", "deposit", "external", True, True, ["WRITES", "CALLS"], "W:bal→X:out", "env"),
            ("f3", "Function", "helper", "internal", None, None, None, None, None),
        ],
        fn,
    )
    contracts = spark.createDataFrame([("c1", "Contract", "Bank"), ("c2", "Contract", "Token")], "id string, type string, label string")
    states = spark.createDataFrame([("s1", "StateVariable", "balances", ["owner"])], "id string, type string, label string, security_tags array<string>")
    edge = "id string, type string, source string, target string"
    e = lambda t, *ps: spark.createDataFrame([(f"{a}{b}", t, a, b) for a, b in ps], edge)
    edges = {
        "CONTAINS_FUNCTION": e("CONTAINS_FUNCTION", ("c1", "f1"), ("c1", "f2"), ("c2", "f3")),
        "CALLS_CONTRACT": e("CALLS_CONTRACT", ("f1", "c2")),
        "WRITES_STATE": e("WRITES_STATE", ("f1", "s1"), ("f2", "s1")),
        "CALLS": e("CALLS", ("f1", "f2"), ("f2", "f3"), ("f3", "f1")),
    }
    return PropertyGraph({"Function": functions, "Contract": contracts, "StateVariable": states}, edges)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_text_plans():
    p = parse("find functions where visibility in [public, external] and writes_state and not has_access_gate")
    assert p.kind == "logic" and p.match.all[2] == Condition("has_access_gate", "eq", False)
    bad = parse("find functions")
    assert bad.error and bad.properties["parse_hint"]
    top = parse("top 25 pattern:access-control lens:auth summary")
    assert (top.limit, top.patterns, top.lens, top.compact) == (25, ["access-control"], ["auth"], True)
    assert parse("functions excluding msg.sender").properties == {"uses_msg_sender": False}
    flow = parse("attacker-controlled input writes state")
    assert flow.kind == "flow" and {"parameter", "env"} <= set(flow.flow.from_kinds)
    assert parse("edges calls contract").edge_types == ["CALLS_CONTRACT"]
    text = '{"match":{"all":[{"property":"visibility","op":"=","value":"external"}]}}'
    assert parse(text).kind == "logic" and parse(text).raw_text == text and parse(text).match.all[0].op == "eq"
    hinted = apply_hints(parse("find functions where writs_state"), {"writes_state"})
    assert hinted.warnings and hinted.hints == ["nearest to 'writs_state': writes_state"]
    assert parse("{broken").error and parse("find functions where (a").error and parse("find where x").error


def test_text_queries_run(graph):
    assert ids(run.query("find functions where visibility in [public, external] and not has_access_gate", graph).nodes) == ["f1"]
    assert ids(run.query("find functions where has_all_operations([READS, WRITES])", graph).nodes) == ["f1"]
    assert run.query("find functions", graph).error
    assert run.query("edges writes", graph).edges.count() == 2
    got = run.query("find functions where writes_state summary", graph).nodes
    assert got.columns == ["id", "type", "label"]


def test_graph_queries_run(graph):
    q = lambda t: run.query(t, graph)
    assert [tuple(r) for r in q("MATCH (f:Function)-[:WRITES_STATE]->(s:StateVariable {security_tags: ['owner']}) WHERE NOT f.has_access_gate RETURN f.label, s.label").nodes.collect()] == [("withdraw", "balances")]
    assert ids(q("FIND functions WHERE (f)-[:CALLS_CONTRACT]->(:Contract)").nodes) == ["f1"]
    assert ids(q("FIND functions WHERE NOT (f)-[:WRITES_STATE]->()").nodes) == ["f3"]
    assert ids(q("WITH w AS (FIND functions WHERE writes_state) FIND functions IN w WHERE has_access_gate").nodes) == ["f2"]
    assert sorted(r["b_id"] for r in q("MATCH (a:Function {label: 'withdraw'})-[:CALLS*2..3]->(b) RETURN b.id").nodes.collect()) == ["f1", "f3"]
    assert sorted(r["name"] for r in q("DESCRIBE EDGES").nodes.collect()) == sorted(graph.edge_tables)
    flow = q("FLOW FROM (f:Function WHERE kind = 'parameter') TO (s:StateVariable) VIA CALLS, WRITES_STATE EXCLUDE SOURCES ['deposit'] MAX DEPTH 3 RETURN PATHS").nodes
    assert sorted(tuple(r["path"]) for r in flow.collect()) == [("f1", "f2", "s1"), ("f1", "s1")]
    assert q("MATCH (a:Function), (b:Function) WHERE a.id != b.id").error
    assert q("FIND functions IN nothing").error and q("MATCH (a:Function").error
    with pytest.raises(ParseError):
        parse_graph_query("FIND functions WHERE a ===")


def test_missing_is_not_false(graph):
    f = graph.nodes("Function")
    at = lambda tree: ids(f.where(compile_tree(tree, f.columns)))
    assert at(Condition("has_access_gate", "eq", False)) == ["f1"]
    assert at(Not(Condition("has_access_gate"))) == ["f1"]
    assert at(Match(none=(Condition("has_access_gate"),))) == ["f1", "f3"]
    assert at(Match(any=())) == ["f1", "f2", "f3"]
    assert at(Condition("operations", "contains_any", ["READS"])) == ["f1"] and at(Condition("kind", "neq", "env")) == ["f1"]
    assert at(Condition("nothing", "exists", False)) == ["f1", "f2", "f3"] and at(Condition("nothing")) == []
    assert [r[0] for r in f.orderBy("id").select(clause_status(Condition("writes_state"), f.columns)).collect()] == ["matched", "matched", "unknown"]
    with pytest.raises(ValueError):
        compile_tree(Condition("kind", "like", "x"))


TREES = st.recursive(st.sampled_from([Condition("a"), Condition("b"), Condition("n", "gt", 1), Condition("n", "in", [0, 2])]), lambda s: st.one_of(st.builds(Not, s), st.builds(lambda x, y: Both((x, y)), s, s), st.builds(lambda x, y: Either((x, y)), s, s)), max_leaves=6)


def plain(tree, row):
    if isinstance(tree, Condition):
        v = row[tree.property]
        return v is not None and {"eq": lambda: v == tree.value, "gt": lambda: v > tree.value, "in": lambda: v in tree.value}[tree.op]()
    if isinstance(tree, Not):
        if isinstance(tree.item, Condition) and tree.item.op == "eq":
            return row[tree.item.property] is False
        return not plain(tree.item, row)
    parts = [plain(t, row) for t in tree.items]
    return all(parts) if isinstance(tree, Both) else any(parts)


@given(st.lists(TREES, min_size=1, max_size=8))
@settings(max_examples=8, deadline=None)
def test_trees_agree_with_plain_logic(spark, trees):
    data = [{"k": k, "a": a, "b": b, "n": n} for k, (a, b, n) in enumerate((a, b, n) for a in (True, False, None) for b in (True, None) for n in (0, 2, None))]
    df = spark.createDataFrame([tuple(r.values()) for r in data], "k int, a boolean, b boolean, n int")
    got = df.orderBy("k").select(*(compile_tree(t).alias(f"t{i}") for i, t in enumerate(trees))).collect()
    for row, r in zip(data, got, strict=True):
        assert [bool(x) for x in r] == [plain(t, row) for t in trees]


def test_rules_find_and_explain(spark, graph, tmp_path):
    made = tmp_path / "access" / "patterns"
    made.mkdir(parents=True)
    (made / "a.yaml").write_text(json.dumps({"id": "weak", "scope": "Function", "severity": "informational", "lens": ["Authority"], "match": {"all": [{"property": "visibility", "op": "in", "value": ["public", "external"]}, {"property": "writes_state", "value": True}], "none": [{"property": "has_access_gate"}]}}))
    (made / "b.yaml").write_text(json.dumps({"id": "order", "scope": "Function", "match": {"tier_a": {"all": [{"sequence_order": {"before": "CALLS", "after": "WRITES"}}]}, "tier_c": {"all": [{"type": "has_label", "value": "GUARDS", "min_confidence": "medium"}]}}, "aggregation": {"mode": "tier_abc_all"}}))
    (made / "c.yaml").write_text(json.dumps({"id": "sig", "scope": "Function", "match": {"any": [{"signature_matches": "X:out.*W:bal"}]}, "edges": [{"type": "WRITES_STATE", "target_type": "StateVariable"}]}))
    (made / "recipe.yaml").write_text(json.dumps({"id": "inv", "type": "investigation", "trigger": {"graph_signals": [{"property": "writes_state"}]}}))
    got = rules.load_rules(str(tmp_path))
    assert sorted(r.id for r in got) == ["order", "sig", "weak"]
    tags = spark.createDataFrame([("f1", "GUARDS", "high"), ("f2", "GUARDS", "low")], "function_id string, label_id string, confidence string")
    found = {(r["pattern_id"], r["node_id"]): r for r in rules.run_rules(graph, got, explain=True, labels=tags).collect()}
    assert set(found) == {("weak", "f1"), ("order", "f1"), ("sig", "f1")}
    assert found["weak", "f1"]["severity"] == "info" and [x["status"] for x in found["weak", "f1"]["explain"]] == ["matched", "matched", "failed"]
    assert len(files.Recipes().load_all(str(tmp_path))) == 1
    for bad in (tmp_path / "no", made):
        with pytest.raises(rules.RuleSourceError):
            rules.load_rules(str(bad))


def test_paths_grow_with_depth(graph):
    steps = PathSpec(steps=(EdgeSpec("CALLS_CONTRACT", "out", "Contract"), EdgeSpec("CONTAINS_FUNCTION", "out", "Function")))
    assert ids(run.run_plan(Plan(node_types=["Function"], paths=[steps]), graph).nodes) == ["f1"]
    depth = [ids(run.run_plan(Plan(node_types=["Function"], paths=[PathSpec(edge_types=("CALLS", "CALLS_CONTRACT"), max_depth=d, target_type="Contract")]), graph).nodes) for d in (1, 2, 3)]
    assert depth == [["f1"], ["f1", "f3"], ["f1", "f2", "f3"]]
    assert ids(traverse.with_edge(graph.nodes("Function"), graph, traverse.Step("CALLS", "in", "Function"), F.col("label") == "withdraw")) == ["f2"]


def test_pagerank_keeps_its_mass(spark, graph):
    shares = traverse.normalised(traverse.edge_weights(graph.edges("CALLS", "WRITES_STATE")))
    rank = {r["id"]: r["rank"] for r in traverse.personalised_pagerank(shares, spark.createDataFrame([("f1",)], "id string"), iterations=6).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == "f1"
    nodes, edges = traverse.ranked_subgraph(graph, spark.createDataFrame(list(rank.items()), "id string, rank double"), 0.1)
    assert {r["source"] for r in edges.collect()} <= set(ids(nodes))


def test_edge_weight_case(spark):
    e = spark.createDataFrame([(None, "delegatecall", "a", "b", 0.5, True, True), (None, "odd", "a", "c", None, None, None)], "id string, type string, source string, target string, risk_score double, is_tainted boolean, guards_at_source boolean")
    assert [round(r["weight"], 6) for r in traverse.edge_weights(e).orderBy("target").collect()] == [2.34, 0.5]


def test_confidence_cases(spark):
    one = lambda *cs: tuple(spark.range(1).select(*cs).first())
    low, high = confidence.wilson(F.lit(0), F.lit(0))
    assert one(low, high) == (0.0, 1.0)
    low, high = confidence.wilson(F.lit(5), F.lit(5))
    assert tuple(round(x, 4) for x in one(low, high)) == (0.5655, 1.0)
    assert one(confidence.bayes(F.lit(0), F.lit(0)), confidence.bayes(F.lit(8), F.lit(2))) == (0.5, 0.75)
    days = [confidence.decay(F.lit(float(d))) for d in (0, 30, 60, 181, -1)]
    assert tuple(round(x, 6) for x in one(*days)) == (1.0, 0.5, 0.25, 0.0, 1.0)
    assert round(confidence.days_until(0.5), 6) == 30
    with pytest.raises(ValueError):
        confidence.days_until(1)


def test_status_cases(spark):
    s = lambda v, t, w, up: metrics.status(F.lit(v), F.lit(t), F.lit(w), F.lit(up))
    got = spark.range(1).select(s(0.80, 0.80, 0.75, True), s(0.76, 0.80, 0.75, True), s(0.74, 0.80, 0.75, True), s(0.15, 0.15, 0.18, False), s(0.18, 0.15, 0.18, False), s(0.19, 0.15, 0.18, False)).first()
    assert tuple(got) == ("ok", "warning", "critical") * 2
    assert metrics.group("core") == ["detection_rate", "false_positive_rate", "pattern_precision", "time_to_detection"]


def test_scores_and_tiers(spark):
    rows = [(w, k, s) for w, ss in {"up": (96, 97, 100), "down": (3, 10, 0), "flat": (50, 50, 50), "both": (95, 95, 95), "few": (99, 99), "lost": (10, 20, 30, 40, 45), "won": (91, 95, 99, 92, 93)}.items() for k, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "w string, k int, s int")
    got = {r["w"]: r["anomaly"] for r in scores.anomalies(df, "w", "k", "s").collect()}
    assert got == {"up": "CEILING", "down": "FLOOR", "flat": "ZERO_VARIANCE", "both": "CEILING"}
    tiers = spark.createDataFrame([("lost", "standard"), ("won", "core")], "w string, tier string")
    assert {r["w"]: (r["new_tier"], r["how"]) for r in scores.tier_moves(df, tiers, "w", "k", "s").collect()} == {"lost": ("important", "auto"), "won": ("important", "manual")}


def test_benchmark_cases(spark):
    two = spark.createDataFrame([("a", "detected", 2, 2, []), ("b", "not-detected", 1, 0, ["x"])], "challenge_id string, status string, expected int, actual int, false_positives array<string>")
    r = evaluate.challenge_rates(two).first()
    assert (r["total"], r["detected"], r["detection_rate"], r["avg_recall"], r["false_positives"]) == (2, 1, 0.5, 0.5, 1)
    now = spark.createDataFrame([("a", "not-detected"), ("n", "not-detected")], "challenge_id string, status string")
    assert {x["challenge_id"]: x["change"] for x in evaluate.compare_runs(now, two.select("challenge_id", "status")).collect()} == {"a": "regressed", "n": "improved"}
    cases = spark.createDataFrame([(True, True)] * 5 + [(False, False)] * 5, "vulnerable boolean, flagged boolean")
    g = evaluate.gauntlet(cases).first()
    assert g["score"] == 10 and g["suspicious"]
    empty = evaluate.micro_scores(spark.createDataFrame([(0, 0, 3)], "tp int, fp int, fn int")).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0, 0, 0)


def test_work_items_and_overlays(spark):
    schema = files.WORK_SCHEMA
    line = lambda pos, i, status, blockers=(), pool="p": (pos, i, "t", status, "high", 1, None, None, None, list(blockers), f"2024-01-0{pos}", None, None, None, None, pool)
    log = spark.createDataFrame([line(1, "a", "open"), line(2, "b", "open", ["a"]), line(3, "c", "open", ["gone"]), line(4, "a", "complete")], schema)
    state = overlay.current(log)
    assert ids(overlay.ready(state)) == ["b"] and {r["id"]: r["status"] for r in state.collect()}["a"] == "complete"
    left = spark.createDataFrame([("f", "x", 1), ("g", "x", 1)], "f string, l string, v int")
    right = spark.createDataFrame([("f", "x", 2), (None, "x", 3)], "f string, l string, v int")
    assert sorted((str(r["f"]), r["v"]) for r in overlay.merge(left, right, ["f", "l"]).collect()) == [("None", 3), ("f", 2), ("g", 1)]
    items = spark.createDataFrame([("1", "b", "n", "two"), ("2", "a", "n", "one")], "id string, type string, name string, content string")
    assert overlay.context_pack(items).first()["pack"] == "one\n\ntwo"


def test_clusters_and_rule_ids(spark):
    f = spark.createDataFrame([(k, "f", n, t) for k, (n, t) in enumerate([(1, "a"), (5, "b"), (9, "c"), (30, "a")])], "id int, file string, line int, tool string")
    c = dedup.line_clusters(f, ["file"], "line")
    got = dedup.merged(c.withColumn("confidence", F.lit(0.9)), ["file"], "tool", "confidence").orderBy("cluster").collect()
    assert [(r["findings"], r["tools"], r["boosted"]) for r in got] == [(3, 3, 1.0), (1, 1, 0.9)]
    names_ = spark.createDataFrame([("x.y.reentrancy",), ("p.q",), ("exact",)], "check_id string")
    known = spark.createDataFrame([("reentrancy",), ("y.reentrancy",), ("exact",)], "id string")
    assert {r["check_id"]: r["rule_id"] for r in dedup.resolve_rule(names_, known).collect()} == {"x.y.reentrancy": "y.reentrancy", "p.q": "q", "exact": "exact"}


def test_names_labels_costs_and_encodings(spark):
    x = spark.createDataFrame([("ownerFeeBps",)], "x string").select(names.tokens(F.col("x")), names.name_tags(F.col("x"))).first()
    assert sorted(x[0]) == ["bps", "fee", "owner"] and x[1] == ["fee", "owner"]
    assert spark.range(1).select(F.array_join(labels.categories(F.lit("CONTEXT:LIMIT:x")), ",")).first()[0] == "access_control,dos"
    c = spark.range(1).select(costs.cost(F.lit("deepseek/deepseek-v3.2"), F.lit(1000), F.lit(500)), costs.vendor(F.lit("o3"))).first()
    assert round(c[0], 8) == 0.00044 and c[1] == "unknown"
    m = spark.range(1).select(F.create_map(F.lit("severity"), F.lit("high"), F.lit("own"), F.lit("public")).alias("m"))
    short = m.select(encode.short_map(F.col("m")).alias("s"))
    assert short.first()["s"] == {"sev": "HIGH", "own": "pub"} and short.select(encode.long_map(F.col("s"))).first()[0] == {"severity": "high", "own": "public"}


def test_graph_files_and_logs(spark, graph, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": [{"id": "n", "type": "Function", "label": "l", "properties": {"size": "3", "bad": "x"}, "evidence": [{"file": "a", "line_start": 1, "line_end": 2}]}, {"id": "", "type": "X"}], "edges": [{"id": "e", "type": "CALLS", "source": "n", "target": "gone"}], "metadata": {"schema_version": "1", "build_hash": "h", "timestamp": "t", "scope": "s"}}))
    nodes, edges, meta = files.read_graph_json(spark, str(path))
    wrong = {r["check"]: r["violations"] for r in files.validate_graph(nodes, edges, meta).collect()}
    assert wrong == {"node fields": 1, "node location": 1, "edge fields": 0, "edge source": 0, "edge target": 1, "metadata": 0}
    p = files.promote(nodes.where("id = 'n'"), {"size": "int", "bad": "int"}).first()
    assert (p["size"], p["bad"]) == (3, None)
    files.graph_tables(graph, str(tmp_path / "native"))
    again = files.read_graph_tables(spark, str(tmp_path / "native"), list(graph.node_tables), list(graph.edge_tables))
    assert ids(again.nodes("Function")) == ["f1", "f2", "f3"] and again.edges("CALLS").count() == 3
    catalog = spark.createDataFrame([("a", "x/a.json"), ("a", "x/a.parquet"), ("b", "x/b.json")], "stem string, path string")
    assert files.resolve_graph(catalog, "a") == "x/a.parquet" and files.resolve_graph(catalog, "x/b.json") == "x/b.json"
    for name in (None, "c"):
        with pytest.raises(files.GraphNotFound):
            files.resolve_graph(catalog, name)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.jsonl").write_text('{"log_pos": 1, "id": "a", "status": "open"}\nnot json\n')
    assert files.read_log(spark, str(tmp_path / "log")).where("id is not null").count() == 1
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "s.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "version": "1", "run_id": "r", "metrics": {"m": {"value": 0.5, "unit": "u"}}}')
    assert [r["value"] for r in files.read_snapshots(spark, str(tmp_path / "snap")).collect()] == [0.5]


def test_tool_reports_and_events(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"check_id": "c", "path": "a.sol", "start": {"line": 1}, "end": {"line": 3}, "extra": {"message": "m", "severity": "ERROR"}}]}))
    f = files.tool_findings(spark, str(tmp_path / "r.json"))
    assert f.first()["severity"] == "HIGH" and files.findings_graph(f).first()["id"].startswith("semgrep:")
    (tmp_path / "s.json").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a"}, "region": {"startLine": 4}}}]}]}]}))
    s = files.sarif_findings(spark, str(tmp_path / "s.json")).first()
    assert (s["tool"], s["severity"], s["line_start"], s["line_end"]) == ("t", "INFO", 4, 4)
    good = spark.createDataFrame([('{"event_id": "1", "event_type": "timing", "duration_seconds": 2.5}',)], "value string")
    assert files.decode_events(good).first()["tokens_used"] == 0
    with pytest.raises(Exception, match="unknown event type"):
        files.decode_events(spark.createDataFrame([('{"event_type": "odd"}',)], "value string")).collect()
    c = files.controller_events(spark.createDataFrame([('{"event": "e", "agentId": "a", "subagent_type": "s"}',)], "value string")).first()
    assert tuple(c) == ("e", 0.0, "a", "s")


def test_streams_window_and_drop_late_rows(spark, tmp_path):
    batch = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:04:00", "a", 3.0), ("2024-01-01 01:00:00", "b", 2.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = monitor.timed(monitor.watch(spark, str(tmp_path / "in"), batch.schema))
    out = monitor.tumbling(stream, "5 minutes", ["k"], {"n": F.count("*"), "total": F.sum("v")})
    s = monitor.Session(out, str(tmp_path / "cp"))
    assert s.status == "created"
    s.to_files(str(tmp_path / "out")).drain()
    assert s.status == "finished"
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    assert [(r["k"], r["n"], r["total"]) for r in got] == [("a", 2, 4.0)]  # the last window is still open
    seen = []
    rule = monitor.AlertRule("big", F.col("v") > 1.5)
    monitor.Session(monitor.alerts(monitor.watch(spark, str(tmp_path / "in"), batch.schema), [rule]), str(tmp_path / "cp2")).each_batch(lambda df, k: seen.append(df.count())).drain()
    assert sum(seen) == 2
