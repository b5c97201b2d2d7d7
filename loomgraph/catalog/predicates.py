"""Scans, projections, predicates and query languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import predicates as P
from loomgraph.catalog import query
from loomgraph.functions import confidence, labels, names
from loomgraph.model import key, read, trade_graph
from loomgraph.operators import overlay, rules
from loomgraph.plans import run
from loomgraph.plans.plan import Plan
from loomgraph.predicates import Condition, Match
from loomgraph.sources import files


@query("""select type, count(*) as n from (select 'Region' as type from region union all select 'Nation' from nation union all select 'Customer' from customer
union all select 'Supplier' from supplier union all select 'Part' from part union all select 'Order' from orders) group by type""")
def node_scan(spark, d) -> DataFrame:
    return trade_graph(spark, d).nodes().groupBy("type").agg(F.count("*").alias("n"))


@query("""select type, count(*) as n from (select 'IN_REGION' as type from nation union all select 'IN_NATION' from customer union all select 'IN_NATION' from supplier
union all select 'PLACED' from orders union all select 'CONTAINS_PART' from lineitem union all select 'SHIPPED_BY' from lineitem) group by type""")
def edge_scan(spark, d) -> DataFrame:
    return trade_graph(spark, d).edges().groupBy("type").agg(F.count("*").alias("n"))


@query("select 'Customer:' || c_custkey as id, 'Customer' as type, c_name as label from customer order by 1 limit 25")
def typed_nodes_compact(spark, d) -> DataFrame:
    return run.run_plan(Plan(kind="nodes", node_types=["Customer"], limit=25, compact=True), trade_graph(spark, d)).nodes


@query("select 'Customer:' || o_custkey || '->Order:' || o_orderkey as id, 'PLACED' as type, 'Customer:' || o_custkey as source, 'Order:' || o_orderkey as target from orders order by 1 limit 50")
def typed_edges(spark, d) -> DataFrame:
    return run.run_plan(Plan(kind="edges", edge_types=["PLACED"]), trade_graph(spark, d)).edges.select("id", "type", "source", "target")


@query("select 'Part:' || p_partkey as id, p_name as label, p_brand as brand from part where p_partkey in (3, 17, 99)")
def id_lookup(spark, d) -> DataFrame:
    plan = Plan(kind="nodes", node_ids=["Part:3", "Part:17", "Part:99"])
    return run.run_plan(plan, trade_graph(spark, d)).nodes.select("id", "label", "brand")


@query("select 'Customer:' || c_custkey as id, c_acctbal as acctbal from customer where c_acctbal < 0 and c_mktsegment in ('BUILDING', 'MACHINERY')")
def find_bare_and_in(spark, d) -> DataFrame:
    return run.query("find customers where is_indebted and mktsegment in [BUILDING, MACHINERY]", trade_graph(spark, d), limit=None).nodes.select("id", "acctbal")


@query("select 'Customer:' || c_custkey as id from customer where c_acctbal >= 0 and (c_mktsegment = 'AUTOMOBILE' or c_acctbal > 9000)")
def find_not_or_parentheses(spark, d) -> DataFrame:
    return run.query("select customer where not is_indebted and (mktsegment = AUTOMOBILE or acctbal > 9000)", trade_graph(spark, d), limit=None).nodes.select("id")


@query("select 'Part:' || p_partkey as id, p_size as size from part where p_size >= 30 and p_size < 40 and p_retailprice > 1000 and p_retailprice <= 1500")
def find_comparisons(spark, d) -> DataFrame:
    return run.query("show parts where size >= 30 and size < 40 and retailprice > 1000 and retailprice <= 1500", trade_graph(spark, d), limit=None).nodes.select("id", "size")


@query("select 'Order:' || o_orderkey as id from orders where o_orderstatus <> 'O' and o_orderpriority not in ('1-URGENT', '5-LOW')")
def find_neq_not_in(spark, d) -> DataFrame:
    plan = Plan(node_types=["Order"], match=Match(all=(Condition("status", "!=", "O"), Condition("priority", "not_in", ["1-URGENT", "5-LOW"]))), limit=None)
    return run.run_plan(plan, trade_graph(spark, d)).nodes.select("id")


@query("select 'Part:' || p_partkey as id, p_name as label from part where regexp_matches(p_name, '^(small|red) .*(ring|widget)$')")
def find_regex(spark, d) -> DataFrame:
    return run.query("find parts where label regex '^(small|red) .*(ring|widget)$'", trade_graph(spark, d), limit=None).nodes.select("id", "label")


@query("select 'Customer' as type, count(*) as n from customer where c_mktsegment is not null")
def find_exists(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    nodes = g.nodes("Customer", "Supplier", "Part")
    return nodes.where(P.condition(Condition("mktsegment", "exists"), nodes.columns)).groupBy("type").agg(F.count("*").alias("n"))


_ORDER_FLAGS = "(select l_orderkey as k, list_sort(list(distinct l_returnflag)) as flags, list_sort(list(distinct l_linestatus)) as states from lineitem group by 1)"


def order_arrays(spark, d) -> DataFrame:
    line = read(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.array_sort(F.collect_set("l_linestatus")).alias("states"))


@query(f"""select count(*) filter (list_contains(flags, 'R')) as contains_r, count(*) filter (list_has_any(flags, ['A', 'N'])) as any_an, count(*) filter (list_has_all(flags, ['A', 'N', 'R'])) as all_anr,
count(*) filter (not list_has_any(flags, ['R'])) as none_r from {_ORDER_FLAGS}""")
def array_predicates(spark, d) -> DataFrame:
    n = lambda c: F.count_if(P.condition(c))
    return order_arrays(spark, d).agg(
        n(Condition("flags", "contains", "R")).alias("contains_r"),
        n(Condition("flags", "contains_any", ["A", "N"])).alias("any_an"),
        n(Condition("flags", "contains_all", ["A", "N", "R"])).alias("all_anr"),
        F.count_if(P.match(Match(none=(Condition("flags", "contains_any", ["R"]),)))).alias("none_r"),
    )


@query("""select 'Part:' || p_partkey as id from part where p_size >= 10 and p_type = 'PROMO' and (p_brand = 'Brand#7' or p_brand = 'Brand#19' or p_retailprice > 1800) and not (p_size = 20 or regexp_matches(p_name, 'ring'))""")
def all_any_none(spark, d) -> DataFrame:
    m = Match(
        all=(Condition("size", "gte", 10), Condition("ptype", "eq", "PROMO")),
        any=(Condition("brand", "eq", "Brand#7"), Condition("brand", "=", "Brand#19"), Condition("retailprice", ">", 1800)),
        none=(Condition("size", "eq", 20), Condition("label", "regex", "ring"), Condition("no_such_property", "eq", True)),
    )
    return run.run_plan(Plan(node_types=["Part"], match=m, limit=None), trade_graph(spark, d)).nodes.select("id")


def user_sequences(spark, d) -> DataFrame:
    """The event types of each user's day in order, as operations and as a signature."""
    e = read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    ops = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id", "day").agg(ops.alias("operations")).withColumn("behavioral_signature", F.array_join("operations", "→"))


_SEQ = "(select user_id, strftime(ts, '%Y-%m-%d') as day, list(event_type order by ts, event_id) as ops, string_agg(event_type, '→' order by ts, event_id) as sig from events group by 1, 2)"


@query(f"""select user_id, day, list_contains(ops, 'error') as has_error, list_has_all(ops, ['click', 'purchase']) as has_both, list_has_any(ops, ['signup', 'view']) as has_any,
coalesce(list_position(ops, 'view') < len(ops) + 1 - nullif(list_position(list_reverse(ops), 'purchase'), 0) and list_position(ops, 'view') > 0, false) as view_then_purchase, regexp_matches(sig, 'click→(view|error)') as signature from {_SEQ}""")
def operation_predicates(spark, d) -> DataFrame:
    ops = F.col("operations")
    return user_sequences(spark, d).select(
        "user_id",
        "day",
        P.has_operation(ops, "error").alias("has_error"),
        P.has_all_operations(ops, ["click", "purchase"]).alias("has_both"),
        P.has_any_operation(ops, ["signup", "view"]).alias("has_any"),
        P.happens_before(ops, "view", "purchase").alias("view_then_purchase"),
        P.signature_matches(F.col("behavioral_signature"), "click→(view|error)").alias("signature"),
    )


@query("""select d.doc_id, exists(select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1) as risky, exists(select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as good
from documents d where exists(select 1 from labels l where l.doc_id = d.doc_id)""")
def label_predicates(spark, d) -> DataFrame:
    """has_label by semi join, missing_label by anti join, and the rest by their marks."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    lab = read(spark, d, "labels")
    marks = lab.groupBy(F.col("doc_id").alias("k")).agg(F.bool_or(F.col("toxic") == 1).alias("risky"), F.bool_or(F.col("quality") == 1).alias("good"))
    return docs.join(marks, F.col("id") == F.col("k")).select(F.col("id").alias("doc_id"), "risky", "good")


def function_labels(spark, d) -> DataFrame:
    lab = read(spark, d, "labels")
    name = F.when(F.col("toxic") == 1, "IS_RATE_LIMITER").when(F.col("quality") == 1, "IS_ACCESS_GATE").otherwise("GUARDS")
    level = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    return lab.select(F.col("doc_id").cast("string").alias("function_id"), name.alias("label_id"), level.alias("confidence"))


_LABELS = """(select cast(doc_id as varchar) as f, case when toxic = 1 then 'IS_RATE_LIMITER' when quality = 1 then 'IS_ACCESS_GATE' else 'GUARDS' end as l,
case when doc_id % 3 = 0 then 3 when doc_id % 3 = 1 then 2 else 1 end as r from labels)"""


@query(f"select f as id from {_LABELS} where l = 'IS_ACCESS_GATE' and r >= 2")
def rule_has_label(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return overlay.with_any_label(docs, function_labels(spark, d), ["IS_ACCESS_GATE"], "medium")


@query(f"select f as function_id, count(*) as n_labels, string_agg(distinct l, ',' order by l) as labels, max(r) as best from {_LABELS} group by 1")
def label_functions(spark, d) -> DataFrame:
    p = overlay.label_profile(function_labels(spark, d))
    return p.select("function_id", "n_labels", F.array_join("labels", ",").alias("labels"), "best")


@query("""select mode, count(*) filter (case mode when 'tier_abc_all' then a and b and c else a end) as n from (select c_acctbal > 0 as a, c_mktsegment = 'BUILDING' as b, c_nationkey < 10 as c from customer),
(values ('tier_a_only'), ('tier_abc_all'), ('tier_b_enhances')) t(mode) group by mode""")
def tier_modes(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    a, b, t = F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 10
    out = c.agg(*(F.count_if(P.tiers(a, b, t, m)).alias(m) for m in ("tier_a_only", "tier_abc_all", "tier_b_enhances")))
    return out.unpivot([], list(out.columns), "mode", "n")


@query("""select 'Customer:' || c_custkey as id, case when c_acctbal < 0 then 'matched' else 'failed' end as debt, case when c_mktsegment = 'BUILDING' then 'matched' else 'failed' end as segment, 'unknown' as missing from customer""")
def clause_statuses(spark, d) -> DataFrame:
    nodes = trade_graph(spark, d).nodes("Customer")
    s = lambda c: P.clause_status(c, nodes.columns)
    return nodes.select("id", s(Condition("is_indebted")).alias("debt"), s(Condition("mktsegment", "eq", "BUILDING")).alias("segment"), s(Condition("brand", "eq", "x")).alias("missing"))


@query("""select conv_id, turn, case when length(text) < 50 then regexp_matches(text, '(?i)error|est|the') else regexp_matches(split_part(text, chr(10), 1), '(?i)error|est|the') end as is_error from conversations""")
def error_results(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", overlay.is_error(F.col("text"), ["error", "est", "the"]).alias("is_error"))


@query("""select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then true else false end as privileged from customer""")
def privileged_state(spark, d) -> DataFrame:
    tags = F.array(F.when(F.col("c_mktsegment") == "BUILDING", "owner").when(F.col("c_mktsegment") == "MACHINERY", "oracle").otherwise("balance"))
    return read(spark, d, "customer").select("c_custkey", names.privileged(tags).alias("privileged"))


@query("""with r as (select ['TRIGGERS', 'NOT_KNOWN', 'IS_RATE_LIMITER', 'IS_ACCESS_GATE', 'CONTEXT:LIMIT:x'][doc_id % 5 + 1] as l, ['', 'dos', 'access_control', 'oracle'][doc_id // 5 % 4 + 1] as cat from labels)
select l, cat, (cat = '' or l in ('TRIGGERS', 'NOT_KNOWN') or (l = 'IS_RATE_LIMITER' and cat = 'dos') or (l = 'IS_ACCESS_GATE' and cat = 'access_control') or (l = 'CONTEXT:LIMIT:x' and cat in ('dos', 'access_control'))) as relevant,
l <> 'NOT_KNOWN' as valid, count(*) as n from r group by all""")
def label_relevance(spark, d) -> DataFrame:
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    k = F.col("doc_id")
    r = read(spark, d, "labels").select(pick(("TRIGGERS", "NOT_KNOWN", "IS_RATE_LIMITER", "IS_ACCESS_GATE", "CONTEXT:LIMIT:x"), k).alias("l"), pick(("", "dos", "Access-Control", "oracle"), F.floor(k / 5)).alias("c"))
    return r.groupBy("l", labels.category(F.col("c")).alias("cat"), labels.relevant(F.col("l"), F.col("c")).alias("relevant"), labels.valid(F.col("l")).alias("valid")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) filter (a <= 15) as relevant from (select event_type, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 86400000000.0 as a from events) group by 1")
def decay_relevance(spark, d) -> DataFrame:
    days = confidence.age_days(F.col("ts").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count_if(confidence.relevant(days, max_age=15.0)).alias("relevant"))


@query("select page_id from pages where coalesce(case when page_id % 4 = 0 then not (page_id % 8 = 0) end, starts_with(url, 'http://th'))")
def dependency_paths(spark, d) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, F.col("page_id") % 8 == 0).alias("is_dependency"))
    return files.project_rows(pages, "http://th", path="url").select("page_id")


@query(f"select user_id, day, len(list_intersect(ops, ['signup', 'purchase'])) as supporting from {_SEQ} where list_has_all(ops, ['click', 'view']) and not list_contains(ops, 'error')")
def attack_candidates(spark, d) -> DataFrame:
    """Required operations there, no false-positive indicator, scored by supporting ones."""
    ops = F.col("operations")
    s = user_sequences(spark, d).where(P.has_all_operations(ops, ["click", "view"]) & ~P.has_operation(ops, "error"))
    return s.select("user_id", "day", F.size(F.array_intersect(ops, F.array(F.lit("signup"), F.lit("purchase")))).cast("bigint").alias("supporting"))


@query("select 'Customer:' || c_custkey as id, c_acctbal < 0 or c_mktsegment = 'BUILDING' as either, c_acctbal < 0 and c_mktsegment = 'BUILDING' as both from customer")
def trigger_signals(spark, d) -> DataFrame:
    nodes = trade_graph(spark, d).nodes("Customer")
    signals = {"graph_signals": [{"property": "is_indebted"}, {"property": "mktsegment", "value": "BUILDING"}]}
    known = set(nodes.columns)
    return nodes.select("id", files.trigger({"trigger": signals}, known).alias("either"), files.trigger({"trigger": signals | {"require_all": True}}, known).alias("both"))


def sample_rules() -> list[rules.Rule]:
    return [
        rules.rule_from(x)
        for x in (
            {"id": "debt", "scope": "Customer", "severity": "high", "lens": ["Credit"], "match": {"all": [{"property": "is_indebted"}]}},
            {"id": "rich-builder", "scope": "Customer", "severity": "informational", "lens": ["Credit", "Sales"], "match": {"all": [{"property": "is_wealthy", "op": "eq", "value": True}, {"property": "mktsegment", "op": "in", "value": ["BUILDING"]}], "none": [{"property": "is_indebted"}]}},
            {"id": "large-part", "scope": "Part", "severity": "low", "lens": ["Stock"], "match": {"all": [{"property": "is_large"}], "any": [{"property": "ptype", "value": "PROMO"}, {"property": "label", "op": "regex", "value": "ring$"}]}},
            {"id": "debt-buys-large", "scope": "Customer", "severity": "critical", "lens": ["Credit"], "match": {"all": [{"property": "is_indebted"}], "paths": [{"steps": [{"edge_type": "PLACED", "target_type": "Order"}, {"edge_type": "CONTAINS_PART", "target_type": "Part"}]}]}},
            {"id": "open-order-by-rich", "scope": "Order", "severity": "medium", "lens": ["Sales"], "match": {"all": [{"property": "is_open"}], "edges": [{"type": "PLACED", "direction": "in", "target_type": "Customer", "target_match": {"all": [{"property": "is_wealthy"}]}}]}},
        )
    ]


_FINDINGS = """(select 'debt' as pattern_id, 'high' as severity, 'Customer:' || c_custkey as node_id from customer where c_acctbal < 0
union all select 'rich-builder', 'info', 'Customer:' || c_custkey from customer where c_acctbal > 9000 and c_mktsegment = 'BUILDING'
union all select 'large-part', 'low', 'Part:' || p_partkey from part where p_size >= 40 and (p_type = 'PROMO' or regexp_matches(p_name, 'ring$'))
union all select 'debt-buys-large', 'critical', 'Customer:' || c_custkey from customer where c_acctbal < 0 and exists (select 1 from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey)
union all select 'open-order-by-rich', 'medium', 'Order:' || o_orderkey from orders join customer on c_custkey = o_custkey where o_orderstatus = 'O' and c_acctbal > 9000)"""


@query(f"select * from {_FINDINGS}")
def rule_scan(spark, d) -> DataFrame:
    """Fused rules, an edge rule and a path rule."""
    return rules.run_rules(trade_graph(spark, d), sample_rules()).select("pattern_id", "severity", "node_id")


@query(f"select pattern_id, severity, count(*) as n from {_FINDINGS} where pattern_id in ('debt', 'rich-builder', 'debt-buys-large') group by 1, 2")
def rules_by_lens(spark, d) -> DataFrame:
    got = run.query("lens:credit", trade_graph(spark, d), sample_rules(), limit=None).findings
    return got.groupBy("pattern_id", "severity").agg(F.count("*").alias("n"))


@query("""select 'Customer:' || c_custkey as node_id, 'all: is_wealthy eq True=matched;all: mktsegment in [''BUILDING'']=matched;none: is_indebted eq True=failed' as explain
from customer where c_acctbal > 9000 and c_mktsegment = 'BUILDING'""")
def rule_explain(spark, d) -> DataFrame:
    got = rules.run_rules(trade_graph(spark, d), [r for r in sample_rules() if r.id == "rich-builder"], explain=True)
    return got.select("node_id", F.array_join(F.transform("explain", lambda x: F.concat(x["clause"], F.lit("="), x["status"])), ";").alias("explain"))


@query("""select 'Part:' || p_partkey as node_id, 1 + (p_type = 'PROMO')::int + regexp_matches(p_name, 'ring$')::int as matched, 2 - (p_type = 'PROMO')::int - regexp_matches(p_name, 'ring$')::int as failed, 0 as unknown, 'supported' as verdict
from part where p_size >= 40 and (p_type = 'PROMO' or regexp_matches(p_name, 'ring$'))
union all select 'Part:' || p_partkey, (p_size >= 40)::int, (p_size < 40)::int, 1, 'insufficient_evidence' from part where p_size >= 40""")
def result_clauses(spark, d) -> DataFrame:
    """A rule whose clauses are all known, and one that also asks for a property that parts lack."""
    loose = rules.rule_from({"id": "loose", "scope": "Part", "severity": "low", "match": {"all": [{"property": "is_large"}], "none": [{"property": "weight", "op": "gt", "value": 5}]}})
    got = rules.run_rules(trade_graph(spark, d), [*(r for r in sample_rules() if r.id == "large-part"), loose], explain=True)
    m = rules.clause_matrix(got)
    return m.select("node_id", *(F.size(f"{s}_clauses").alias(s) for s in ("matched", "failed", "unknown")), "verdict")


@query(f"""select coalesce('Nation:' || c_nationkey, 'unknown') as owner, count(*) filter (pattern_id in ('debt', 'rich-builder')) as "Credit", count(*) filter (pattern_id = 'rich-builder') as "Sales", count(*) filter (pattern_id = 'large-part') as "Stock", count(*) as total, count(*) as listed
from {_FINDINGS} f left join customer on node_id = 'Customer:' || c_custkey where pattern_id in ('debt', 'rich-builder', 'large-part') group by 1""")
def lens_report(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    found = rules.run_rules(g, [r for r in sample_rules() if r.id in ("debt", "rich-builder", "large-part")])
    owner = read(spark, d, "customer").select(key("Customer", "c_custkey").alias("node_id"), key("Nation", "c_nationkey").alias("owner"))
    parts = rules.lens_report(found, owner, ["Credit", "Sales", "Stock"])
    # an owner with many findings has several parts
    return parts.groupBy("owner", "Credit", "Sales", "Stock", "total").agg(F.sum(F.size("findings")).alias("listed"))


@query(f"""select lens, f.severity, count(*) as n from {_FINDINGS} f join (values ('debt', 'Credit'), ('rich-builder', 'Credit'), ('rich-builder', 'Sales'), ('large-part', 'Stock'), ('debt-buys-large', 'Credit'), ('open-order-by-rich', 'Sales')) t(p, lens) on p = pattern_id group by 1, 2""")
def rule_distribution(spark, d) -> DataFrame:
    """Findings by the lenses and severities of their rules."""
    table = rules.rules_table(spark, sample_rules()).select(F.col("id").alias("pattern_id"), "severity", F.explode("lens").alias("lens"))
    found = rules.run_rules(trade_graph(spark, d), sample_rules()).select("pattern_id")
    return found.join(table, "pattern_id").groupBy("lens", "severity").agg(F.count("*").alias("n"))


@query("select * from (values ('Customer'), ('Nation'), ('Order'), ('Part'), ('Region'), ('Supplier')) t(name)")
def describe_types(spark, d) -> DataFrame:
    return run.query("DESCRIBE TYPES", trade_graph(spark, d)).nodes


@query("select * from (values ('acctbal'), ('is_indebted'), ('is_wealthy'), ('key'), ('mktsegment')) t(name)")
def describe_properties(spark, d) -> DataFrame:
    return run.query("DESCRIBE PROPERTIES FOR Customer", trade_graph(spark, d)).nodes


@query("select mktsegment from (select distinct c_mktsegment as mktsegment from customer)")
def property_values(spark, d) -> DataFrame:
    return trade_graph(spark, d).nodes("Customer").select("mktsegment").distinct()


@query("select 'Customer:' || c_custkey as id, c_name as label from customer where c_acctbal < 0 and c_mktsegment = 'BUILDING'")
def named_subquery(spark, d) -> DataFrame:
    text = "WITH risky AS (FIND customers WHERE is_indebted) FIND customers IN risky WHERE mktsegment = 'BUILDING' RETURN id, label"
    return run.query(text, trade_graph(spark, d)).nodes


@query("select 'Part:' || p_partkey as id from part where p_size >= 45 and p_brand = 'Brand#3'")
def json_query(spark, d) -> DataFrame:
    text = '{"node_types": ["Part"], "limit": null, "match": {"all": [{"property": "size", "op": ">=", "value": 45}, {"property": "brand", "op": "=", "value": "Brand#3"}]}}'
    return run.query(text, trade_graph(spark, d)).nodes.select("id")


@query("""select 'find customers where is_indebted and mktsegment = ' || c_mktsegment as text, cast(count(*) filter (c_acctbal < 0) as varchar) as outcome from customer group by c_mktsegment
union all select * from (values ('find customers', 'parse_error'), ('find customers where is_indebtd', 'nearest to ''is_indebtd'': is_indebted'), ('parts where', 'Part')) t(text, outcome)""")
def text_queries(spark, d) -> DataFrame:
    """The answers of texts made from the segments there are, and what texts with faults say."""
    g = trade_graph(spark, d)
    segments = sorted(r[0] for r in g.nodes("Customer").select("mktsegment").distinct().collect())
    out = None
    for s in segments:
        text = f"find customers where is_indebted and mktsegment = {s}"
        one = run.query(text, g, limit=None).nodes.agg(F.count("*").cast("string").alias("outcome")).select(F.lit(text).alias("text"), "outcome")
        out = one if out is None else out.unionByName(one)
    told = []
    for text in ("find customers", "find customers where is_indebtd", "parts where"):
        r = run.query(text, g)
        kinds = "" if r.error or r.hints else ",".join(sorted({t for t in ("Part",) if text.startswith("part")}))
        told.append((text, "parse_error" if r.error else r.hints[0] if r.hints else kinds))
    return out.unionByName(spark.createDataFrame(told, "text string, outcome string"))


@query("""select 'node fields' as "check", (select count(*) from part where p_size = 1) as violations union all select 'node location', 0 union all select 'edge fields', (select count(*) from orders where o_orderstatus = 'P')
union all select 'edge source', 0 union all select 'edge target', (select count(*) from lineitem join part on p_partkey = l_partkey where p_size = 1) + (select count(*) from orders where o_orderstatus = 'P') union all select 'metadata', 1""")
def graph_validation(spark, d) -> DataFrame:
    """A damaged graph: parts without an id, orders placed without a target, and poor metadata."""
    g = trade_graph(spark, d)
    nodes = g.nodes().withColumn("id", F.when((F.col("type") != "Part") | (F.col("size") != 1), F.col("id")))
    lost = g.nodes("Order").where("status = 'P'").select(F.col("id").alias("__o"))
    placed = g.edges("PLACED").join(lost, F.col("target") == F.col("__o"), "left").withColumn("target", F.when(F.col("__o").isNotNull(), "").otherwise(F.col("target"))).drop("__o")
    edges = placed.select("type", "source", "target").unionByName(g.edges("CONTAINS_PART", "IN_NATION", "IN_REGION").select("type", "source", "target"))
    meta = spark.createDataFrame([("1", None, None, "trade")], files.META_SCHEMA)
    return files.validate_graph(nodes, edges, meta).select("check", "violations")
