"""Consensus, risk, cascades, coverage over axes, gates, saved tables, streams and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.cache import ResultCache
from loomgraph.catalog import query
from loomgraph.catalog.predicates import function_labels, sample_rules, user_sequences
from loomgraph.catalog.scalars import _pick, _picked
from loomgraph.functions import costs, encode, metrics, names
from loomgraph.model import PropertyGraph, read, trade_graph
from loomgraph.operators import dedup, evaluate, risk, rules
from loomgraph.operators import traverse as T
from loomgraph.plans import run
from loomgraph.plans.plan import Plan
from loomgraph.scratch import folder
from loomgraph.sources import files
from loomgraph.streaming import monitor

_VOTES = """v as (select l_orderkey as item, l_suppkey as voter, l_returnflag = 'R' as vote, s_acctbal / 10000 + 1.5 as w from lineitem join supplier on s_suppkey = l_suppkey),
c as (select item, count(*) as votes, sum(case when vote then w else 0 end) / sum(w) as support from v group by 1)"""


def _votes(spark, d) -> tuple[DataFrame, DataFrame]:
    votes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("voter"), (F.col("l_returnflag") == "R").alias("vote"))
    return votes, read(spark, d, "supplier").select(F.col("s_suppkey").alias("voter"), (F.col("s_acctbal") / 10000 + 1.5).alias("weight"))


@query(f"with {_VOTES} select item, votes, round(support, 6) as support, support > 0.5 as verdict from c")
def vote_consensus(spark, d) -> DataFrame:
    votes, weights = _votes(spark, d)
    return risk.consensus(votes, "item", "voter", "vote", weights).withColumn("support", F.round("support", 6))


@query(f"with {_VOTES} select voter, count(*) as votes, round((count(*) filter (vote = (support > 0.5)) + 1) / (count(*) + 2), 6) as weight from v join c using (item) group by 1")
def voter_reputation(spark, d) -> DataFrame:
    votes, weights = _votes(spark, d)
    got = risk.reputation(votes, risk.consensus(votes, "item", "voter", "vote", weights), "item", "voter", "vote")
    return got.withColumn("weight", F.round("weight", 6))


@query("""with s as (select c_custkey, least(greatest(-c_acctbal / 1000, 0), 1) * 0.5 + case when c_mktsegment = 'BUILDING' then 0.25 else 0 end + case when c_nationkey < 5 then 0.25 else 0 end as score from customer)
select c_custkey, round(score, 6) as score, case when score >= 0.75 then 'critical' when score >= 0.5 then 'high' when score >= 0.25 then 'medium' else 'low' end as level from s""")
def risk_levels(spark, d) -> DataFrame:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = risk.risk_score({"debt": (-F.col("c_acctbal") / 1000, 2.0), "builder": (flag(F.col("c_mktsegment") == "BUILDING"), 1.0), "near": (flag(F.col("c_nationkey") < 5), 1.0)})
    return read(spark, d, "customer").select("c_custkey", F.round(score, 6).alias("score"), risk.risk_level(score).alias("level"))


@query("""select o_orderpriority, count(*) as attacks, count(*) filter (p > 0) as rational, round(sum(p), 2) as expected from (select o_orderpriority, o_totalprice * (o_custkey % 100) / 100.0 - 1000 - o_totalprice * 0.1 * (1 - (o_custkey % 100) / 100.0) as p from orders) group by 1""")
def attack_payoffs(spark, d) -> DataFrame:
    price, chance = F.col("o_totalprice"), F.col("o_custkey") % 100 / 100.0
    p = read(spark, d, "orders").select("o_orderpriority", risk.payoff(price, chance, F.lit(1000.0), price * 0.1).alias("p"))
    return p.groupBy("o_orderpriority").agg(F.count("*").alias("attacks"), F.count_if(F.col("p") > 0).alias("rational"), F.round(F.sum("p"), 2).alias("expected"))


@query("""with g as (select p_partkey, p_size % 7 as a, p_size % 5 as b, p_partkey % 6 as c, p_partkey % 4 as d from part)
select p_partkey, round(case when greatest(least(a, b), least(c, d)) = least(greatest(a, c), greatest(b, d)) then case when least(a, b) >= least(c, d) then 1.0 else 0.0 end else (d - c) / (a - b - c + d) end, 6) as share from g""")
def mixed_strategies(spark, d) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", F.round(risk.mixed_equilibrium(s % 7, s % 5, k % 6, k % 4), 6).alias("share"))


@query("""with p as (select c_custkey as cause, l_suppkey as effect, o_orderkey as k, least(o_totalprice / 1000000 * l_discount, 1) as p from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where c_acctbal > 9500)
select cause, effect, round(1 - exp(sum(ln(1 - p))), 9) as chance, round(coalesce(1 - exp(sum(ln(1 - p)) filter (k % 3 <> 0)), 0), 9) as spared from p group by 1, 2""")
def causal_effects(spark, d) -> DataFrame:
    """The chance that a customer's orders reach a supplier, and without a third of the orders."""
    rich = read(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_custkey").alias("cause"))
    first = read(spark, d, "orders").select(F.col("o_custkey").alias("cause"), F.col("o_orderkey").alias("middle"), (F.col("o_totalprice") / 1e6).alias("chance")).join(rich, "cause", "left_semi")
    second = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("middle"), F.col("l_suppkey").alias("effect"), F.col("l_discount").alias("chance"))
    spared = risk.causal_paths(first, second, F.col("middle") % 3 == 0).withColumnRenamed("chance", "spared")
    both = risk.causal_paths(first, second).join(spared, ["cause", "effect"], "left")
    return both.select("cause", "effect", F.round("chance", 9).alias("chance"), F.round(F.coalesce("spared", F.lit(0.0)), 9).alias("spared"))


@query("""with e as (select 'Customer:' || c_custkey as s, 'Nation:' || c_nationkey as t from customer union all select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey from supplier union all select 'Nation:' || n_nationkey, 'Region:' || n_regionkey from nation),
s0 as (select 'Customer:' || c_custkey as id, 1.0 as x from customer where c_acctbal < -900), s1 as (select t as id, sum(x) * 0.5 as x from e join s0 on id = s group by 1), s2 as (select t as id, sum(x) * 0.5 as x from e join s1 on id = s group by 1)
select id, round(sum(x), 6) as impact from (select * from s0 union all select * from s1 union all select * from s2) group by 1""")
def dependency_cascade(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    shares = T.normalised(g.edges("IN_NATION", "IN_REGION").select("source", "target", F.lit(1.0).alias("weight")))
    shock = g.nodes("Customer").where("acctbal < -900").select("id", F.lit(1.0).alias("impact"))
    return risk.cascade(shares, shock, 0.5, 2).withColumn("impact", F.round("impact", 6))


@query("select event_type, coalesce(code, '') as code, coalesce(title, '') as title, count(*) as n from events left join (values ('click', 'T-1', 'pressed'), ('error', 'T-2', 'failed')) t(k, code, title) on k = event_type group by 1, 2, 3")
def taxonomy_enrichment(spark, d) -> DataFrame:
    taxonomy = spark.createDataFrame([("click", "T-1", "pressed"), ("error", "T-2", "failed")], "event_type string, code string, title string")
    got = risk.enriched(read(spark, d, "events").select("event_type"), taxonomy, "event_type")
    return got.groupBy("event_type", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("title", F.lit("")).alias("title")).agg(F.count("*").alias("n"))


@query("""with r as (select value > 50 as p, event_type as a, cast(user_id % 5 as varchar) as b, cast(event_id % 3 as varchar) as c, case when value > 100 then 'high' else 'low' end as e from events),
w as (select * from (values ('workflow', 'click'), ('workflow', 'purchase'), ('workflow', 'nothing'), ('dimension', '0'), ('dimension', '4'), ('tier', 'high'), ('tier', 'low'), ('contract', '0'), ('contract', '2')) t(axis, value)),
l as (select 'workflow' as axis, a as value, p from r union all select 'dimension', b, p from r union all select 'contract', c, p from r union all select 'tier', e, p from r)
select w.axis, w.value, count(l.p) as n, round_even(coalesce(count(*) filter (l.p) / nullif(count(l.p), 0), 0), 3) as share, round_even(coalesce(count(*) filter (l.p) / nullif(count(l.p), 0), 0), 3) < 0.5 as gap from w left join l on l.axis = w.axis and l.value = w.value group by 1, 2""")
def coverage_axes(spark, d) -> DataFrame:
    v = F.col("value")
    r = read(spark, d, "events").select((v > 50).alias("passed"), F.col("event_type").alias("workflow"), (F.col("user_id") % 5).alias("dimension"), (F.col("event_id") % 3).alias("contract"), F.when(v > 100, "high").otherwise("low").alias("tier"))
    return evaluate.coverage_axes(r, {"workflow": ["click", "purchase", "nothing"], "dimension": ["0", "4"], "tier": ["high", "low"], "contract": ["0", "2"]})


@query("""with r as (select o_orderpriority as k, 100 + o_orderkey % 3 as f, 1000 + o_custkey % (100 * cast(left(o_orderpriority, 1) as int)) as t, 10.0 + o_orderkey % 4 as s from orders),
g as (select k, stddev_pop(f) / avg(f) as findings_cv, max(f) - min(f) as findings_delta, (max(t) - min(t)) / min(t) as tokens_delta, (max(s) - min(s)) / min(s) as seconds_delta from r group by 1)
select k, round(findings_cv, 6) as findings_cv, findings_delta, round(tokens_delta, 6) as tokens_delta, round(seconds_delta, 6) as seconds_delta, findings_cv <= 0.15 and findings_delta <= 2 and tokens_delta <= 0.25 and seconds_delta <= 0.30 as passed from g""")
def stability_gates(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    r = read(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (100 + k % 3).alias("findings"), (1000 + F.col("o_custkey") % (100 * F.substring("o_orderpriority", 1, 1).cast("int"))).alias("tokens"), (10.0 + k % 4).alias("seconds"))
    return evaluate.stability_gates(r, "k").withColumns({c: F.round(c, 6) for c in ("findings_cv", "tokens_delta", "seconds_delta")})


_FIELDS = ", ".join(f"('{n}', {i})" for i, n in enumerate(evaluate.DOCUMENT_FIELDS))
_WORDS = ", ".join(f"('{n}', '{'|'.join(w)}')" for n, w in evaluate.AUTH_WORDS.items())


@query(f"""with x as (select doc_id, ['access-control', 'logic', 'oracle'][doc_id % 3 + 1] as category, lower(text) as t from documents),
m as (select doc_id, n from x, (values {_FIELDS}) f(n, i) where (doc_id * 7 + i * 3) % 5 = 0 union all select doc_id, n from x, (values {_WORDS}) w(n, p) where category in ('access-control', 'logic') and not coalesce(regexp_matches(t, p), false))
select x.doc_id, round((20 + case when category = 'oracle' then 0 else 4 end - count(n)) / (20 + case when category = 'oracle' then 0.0 else 4.0 end), 6) as share, coalesce(string_agg(n, ',' order by n), '') as missing from x left join m using (doc_id) group by x.doc_id, category""")
def document_completeness(spark, d) -> DataFrame:
    k = F.col("doc_id")
    filled = F.filter(F.array(*map(F.lit, evaluate.DOCUMENT_FIELDS)), lambda x, i: (k * 7 + i * 3) % 5 != 0)
    share, missing = evaluate.document_completeness(filled, _pick(("access-control", "logic", "oracle"), k), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.round(share, 6).alias("share"), F.array_join(missing, ",").alias("missing"))


@query("""with e as (select ['scaffold', 'verdict', 'timing', 'detection'][event_id % 4 + 1] as k, user_id % 3 <> 0 as ok, value, user_id from events)
select round(count(*) filter (k = 'scaffold' and ok) / count(*) filter (k = 'scaffold'), 6) as scaffold_compile_rate, round(count(*) filter (k = 'verdict' and ok) / count(*) filter (k = 'verdict'), 6) as llm_autonomy, round(avg(value) filter (k = 'timing'), 6) as time_to_detection,
round(avg(user_id) filter (k = 'verdict'), 6) as token_efficiency, round(count(*) filter (k = 'verdict' and not ok) / count(*) filter (k = 'verdict'), 6) as escalation_rate from e""")
def work_indicators(spark, d) -> DataFrame:
    """Typed events of JSON texts, and the five indicators beside detection."""
    k, ok = _pick(("scaffold", "verdict", "timing", "detection"), F.col("event_id")), F.col("user_id") % 3 != 0
    fields = F.struct(k.alias("event_type"), F.when(k == "scaffold", ok).alias("compiled"), F.when(k == "verdict", ok).alias("auto_resolved"), F.when(k == "timing", F.col("value")).alias("duration_seconds"), F.when(k == "verdict", F.col("user_id")).alias("tokens_used"))
    got = metrics.work_indicators(files.decode_events(read(spark, d, "events").select(F.to_json(fields).alias("value"))))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(f"""select kind, code, count(e.k) as n from (values {", ".join(f"('evidence_missing', '{c}', {i})" for i, c in enumerate(rules.EVIDENCE_MISSING))}, {", ".join(f"('omission', '{c}', {i + 7})" for i, c in enumerate(rules.OMISSION))}) t(kind, code, i) left join (select event_id % 16 as k from events) e on e.k = i group by 1, 2""")
def reason_code_counts(spark, d) -> DataFrame:
    """How often each reason was given; codes out of the vocabularies are left out."""
    codes = [*rules.EVIDENCE_MISSING, *rules.OMISSION, "other", "none", ""]
    given = read(spark, d, "events").select(_pick(tuple(codes), F.col("event_id")).alias("__c")).groupBy("__c").agg(F.count("*").alias("n"))
    return rules.reason_codes(spark).join(given, F.col("code") == F.col("__c"), "left").select("kind", "code", F.coalesce("n", F.lit(0)).alias("n"))


@query("""with l as (select doc_id, case when toxic = 1 then 'IS_RATE_LIMITER' when quality = 1 then 'IS_ACCESS_GATE' else 'GUARDS' end as l from labels), h as (select d.doc_id, count(distinct l) filter (l in ('IS_ACCESS_GATE', 'GUARDS')) as held from documents d left join l using (doc_id) group by 1)
select case when held >= 2 then 'decided' when held > 0 then 'unknown' else 'skippable' end as coverage, count(*) as n from h group by 1""")
def label_coverage(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return rules.label_coverage(docs, ("IS_ACCESS_GATE", "GUARDS"), function_labels(spark, d)).groupBy("coverage").agg(F.count("*").alias("n"))


@query("select 'Part:' || p_partkey as id, 'Part' as type, p_name as label, p_type as ptype, p_size >= 40 as is_large from part")
def graph_slices(spark, d) -> DataFrame:
    """What the rules of one lens look at."""
    return rules.graph_slice(trade_graph(spark, d), sample_rules(), lens="Stock").nodes()


@query("""select 'Customer:' || c_custkey as source, 'Part:' || l_partkey as target, 2 as depth, 'Customer:' || c_custkey || '>Order:' || o_orderkey || '>Part:' || l_partkey as path
from customer join orders on o_custkey = c_custkey join (select distinct l_orderkey, l_partkey from lineitem) l on l_orderkey = o_orderkey join part on p_partkey = l_partkey where c_acctbal < -800 and p_size >= 46 and o_orderstatus <> 'F' and c_name <> 'Customer#000000007'""")
def flow_excluded(spark, d) -> DataFrame:
    """Unsafe paths in the language: finished orders sanitise, and a source is excluded."""
    g = trade_graph(spark, d)
    nodes = dict(g.node_tables) | {"Order": g.node_tables["Order"].withColumn("is_sanitizer", F.col("status") == "F")}
    text = "FLOW FROM (c:Customer WHERE acctbal < -800) TO (p:Part WHERE size >= 46) VIA PLACED, CONTAINS_PART EXCLUDE SOURCES ['Customer#000000007'] MAX DEPTH 2 RETURN UNSAFE PATHS"
    return run.query(text, PropertyGraph(nodes, g.edge_tables, g.meta, g.keys)).nodes.withColumn("path", F.array_join("path", ">"))


@query("""with recursive p as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) > 0.55),
e as (select a as u, b as v from p union select b, a from p), r(u, v) as (select vec_id, vec_id from embeddings union select r.u, e.v from r join e on e.u = r.v) select u as id, min(v) as cluster from r group by u""")
def embedding_clusters(spark, d) -> DataFrame:
    return dedup.embedding_clusters(read(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.55)


@query("""select o_orderkey, case o_orderstatus when 'F' then 'verified' when 'P' then 'violated' else 'open' end as state, 'assert(total <= ' || cast(o_custkey as varchar) || '); // ' || o_orderpriority as assertion from orders""")
def invariant_states(spark, d) -> DataFrame:
    strength = F.when(F.col("o_orderstatus") == "F", "PROVEN").when(F.col("o_orderstatus") == "P", "violated").otherwise("observed")
    return read(spark, d, "orders").select("o_orderkey", names.invariant_state(strength).alias("state"), names.invariant_assertion(F.concat(F.lit("total <= "), F.col("o_custkey").cast("string")), F.col("o_orderpriority")).alias("assertion"))


@query("select 'Day:' || user_id || ':' || day as id from (select user_id, strftime(ts, '%Y-%m-%d') as day, list(event_type) as ops from events group by 1, 2) where list_has_all(ops, ['click', 'purchase']) and list_has_any(ops, ['signup', 'view']) and not list_contains(ops, 'error')")
def function_predicates(spark, d) -> DataFrame:
    days = user_sequences(spark, d).select(F.concat(F.lit("Day:"), F.col("user_id").cast("string"), F.lit(":"), "day").alias("id"), F.lit("Day").alias("type"), F.col("day").alias("label"), "operations")
    text = "find days where has_all_operations([click, purchase]) and has_any_operation([signup, view]) and not has_operation(error)"
    return run.query(text, PropertyGraph({"Day": days}, {}), limit=None).nodes.select("id")


@query("select type as name from (select 'IN_REGION' as type from nation union select 'IN_NATION' from supplier union select 'PLACED' from orders union select 'CONTAINS_PART' from lineitem union select 'SHIPPED_BY' from lineitem)")
def describe_edges(spark, d) -> DataFrame:
    return run.query("DESCRIBE EDGES", trade_graph(spark, d)).nodes


@query("""select mode, count(*) as n, mode = 'full' as has_evidence from pages, (values ('full'), ('none'), ('left out')) t(mode) group by 1""")
def evidence_modes(spark, d) -> DataFrame:
    """Findings as nodes, with and without their places."""
    found = read(spark, d, "pages").select(F.lit("c").alias("check_id"), F.col("url").alias("path"), F.col("page_id").cast("int").alias("line_start"), F.col("page_id").cast("int").alias("line_end"), F.lit("HIGH").alias("severity"), F.lit("m").alias("message"))
    g = PropertyGraph({"ToolFinding": files.findings_graph(found)}, {})
    plans = {"full": Plan(kind="nodes", limit=None), "none": Plan(kind="nodes", limit=None, evidence_mode="none"), "left out": Plan(kind="nodes", limit=None, include_evidence=False)}
    out = None
    for mode, plan in plans.items():
        nodes = run.run_plan(plan, g).nodes
        one = nodes.agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n", F.lit("evidence" in nodes.columns).alias("has_evidence"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""with p as (select p_partkey as k, p_name as n, p_size as s, p_brand as b from part)
select 'SUMMARY' as level, k, '{"id":' || k || ',"meta":{"id":' || s || '}}' as j from p union all select 'DETAILED', k, '{"id":' || k || ',"name":"' || n || '","meta":{"id":' || s || '}}' from p
union all select 'FULL', k, '{"id":' || k || ',"name":"' || n || '","meta":{"id":' || s || ',"raw":"' || b || '"}}' from p""")
def detail_levels(spark, d) -> DataFrame:
    """Allowed and denied names hold at every depth."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("id"), F.col("p_brand").alias("raw")).alias("meta"))
    out = None
    for level in ("SUMMARY", "DETAILED", "FULL"):
        own = encode.detail(p, level, ["id", "meta"], ["raw"])
        one = own.select(F.lit(level).alias("level"), F.col("id").alias("k"), F.to_json(F.struct(*own.columns)).alias("j"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select event_type, tier, round(rate, 6) as rate, rate >= case tier when 'critical' then 1.0 when 'important' then 0.25 else 0.05 end as passed from (select event_type, ['critical', 'important', 'other'][length(event_type) % 3 + 1] as tier, count(*) filter (user_id % 3 <> 0) / count(*) as rate from events group by 1)""")
def tier_rates(spark, d) -> DataFrame:
    g = read(spark, d, "events").groupBy("event_type").agg((F.count_if(F.col("user_id") % 3 != 0) / F.count("*")).alias("rate"))
    g = g.withColumn("tier", _pick(("critical", "important", "other"), F.length("event_type")))
    return g.select("event_type", "tier", F.round("rate", 6).alias("rate"), evaluate.tier_rate(F.col("rate"), F.col("tier")).alias("passed"))


@query("""select coalesce(case r when 'attacker' then 'm-own' when 'verifier' then 'm-2' when 'defender' then 'm-3' end, 'none') as model, count(*) as n from (select ['attacker', 'verifier', 'defender', 'guest'][user_id % 4 + 1] as r from events) group by 1""")
def role_models(spark, d) -> DataFrame:
    role = _pick(("attacker", "verifier", "defender", "guest"), F.col("user_id"))
    model = costs.model_for_role(role, {"attacker": "m-own"}, {"attacker": "m-1", "verifier": "m-2", "defender": "m-3"})
    return read(spark, d, "events").groupBy(F.coalesce(model, F.lit("none")).alias("model")).agg(F.count("*").alias("n"))


@query("""select 'labels' as kind, function_id as k, l as v from (select cast(doc_id as varchar) as function_id, case when toxic = 1 then 'IS_RATE_LIMITER' when quality = 1 then 'IS_ACCESS_GATE' else 'GUARDS' end as l from labels)
union all select 'bounds', event_type, cast(count(*) as varchar) from events group by event_type union all select 'results', cast(o_orderkey as varchar), o_orderstatus from orders""")
def saved_tables(spark, d) -> DataFrame:
    """A label overlay, confidence bounds and benchmark results, written as JSON and read again."""
    at = folder(spark, "saved")
    labels = function_labels(spark, d)
    bounds = read(spark, d, "events").groupBy(F.col("event_type").alias("pattern_id")).agg(F.count("*").alias("samples"))
    results = read(spark, d, "orders").select(F.col("o_orderkey").alias("challenge_id"), F.col("o_orderstatus").alias("status"))
    back = [files.saved(x, f"{at}/{n}") for n, x in (("labels", labels), ("bounds", bounds), ("results", results))]
    pick = lambda x, kind, k, v: x.select(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("k"), F.col(v).cast("string").alias("v"))
    return pick(back[0], "labels", "function_id", "label_id").unionByName(pick(back[1], "bounds", "pattern_id", "samples")).unionByName(pick(back[2], "results", "challenge_id", "status"))


@query("""select rule, severity, count(*) as n from (select 'error' as rule, 'critical' as severity from events where event_type = 'error' union all select 'large', 'warning' from events where value > 200) group by 1, 2""")
def streamed_alerts(spark, d) -> DataFrame:
    """Files as a stream, alerts of each row, written by a streaming session and read again."""
    at = folder(spark, "alerts")
    events = monitor.watch(spark, f"{d}/event[s].parquet", read(spark, d, "events").schema)
    kinds = [monitor.AlertRule("error", F.col("event_type") == "error", "critical"), monitor.AlertRule("large", F.col("value") > 200)]
    monitor.Session(monitor.alerts(events, kinds).select("event_id", "rule", "severity"), f"{at}/state").to_files(f"{at}/out").drain()
    return spark.read.schema("event_id bigint, rule string, severity string").parquet(f"{at}/out").groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as w, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def streamed_windows(spark, d) -> DataFrame:
    """The windows of a stream after its last batch."""
    at = folder(spark, "windows")
    events = monitor.timed(monitor.watch(spark, f"{d}/event[s].parquet", read(spark, d, "events").schema))
    w = monitor.tumbling(events, "1 day", ["event_type"], {"n": F.count("*"), "total": F.sum("value")})
    monitor.Session(w, f"{at}/state", "complete").each_batch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{at}/out")).drain()
    out = spark.read.schema(w.schema).parquet(f"{at}/out")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("w"), "event_type", "n", F.round("total", 3).alias("total"))


_cache = ResultCache()


@query("select 'Customer:' || c_custkey as id from customer where c_acctbal < 0 and c_mktsegment = 'MACHINERY'")
def cached_query(spark, d) -> DataFrame:
    """Asked twice of one graph; the second answer is the table that the first one left."""
    g = trade_graph(spark, d)
    text = "find customers where is_indebted and mktsegment = MACHINERY"
    for _ in range(2):
        out = _cache.get(f"trade {d} {spark.sparkContext.applicationId}", text, lambda: run.query(text, g, limit=None).nodes.select("id"))
    return out
