"""Joins and traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.catalog import query
from loomgraph.model import event_graph, key, read, trade_graph
from loomgraph.operators import dedup, evaluate, overlay
from loomgraph.operators import traverse as T
from loomgraph.plans import run
from loomgraph.plans.plan import EdgeSpec, PathSpec, Plan
from loomgraph.predicates import Condition, Match


@query("select 'Order:' || o_orderkey as id from orders where o_orderstatus = 'O' and exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def edge_requirement(spark, d) -> DataFrame:
    plan = Plan(node_types=["Order"], match=Match(all=(Condition("is_open"),)), edges=[EdgeSpec("CONTAINS_PART", "out", "Part")], limit=None)
    return run.run_plan(plan, trade_graph(spark, d)).nodes.select("id")


@query("select 'Order:' || o_orderkey as id from orders where exists (select 1 from lineitem join part on p_partkey = l_partkey where l_orderkey = o_orderkey and p_brand = 'Brand#7' and p_size >= 40)")
def edge_target_match(spark, d) -> DataFrame:
    spec = EdgeSpec("CONTAINS_PART", "out", "Part", Match(all=(Condition("brand", "eq", "Brand#7"), Condition("is_large"))))
    return run.run_plan(Plan(node_types=["Order"], edges=[spec], limit=None), trade_graph(spark, d)).nodes.select("id")


@query("select 'Customer:' || c_custkey as id from customer where c_acctbal < 0 and exists (select 1 from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey)")
def fixed_path(spark, d) -> DataFrame:
    path = PathSpec(steps=(EdgeSpec("PLACED", "out", "Order"), EdgeSpec("CONTAINS_PART", "out", "Part")))
    plan = Plan(node_types=["Customer"], match=Match(all=(Condition("is_indebted"),)), paths=[path], limit=None)
    return run.run_plan(plan, trade_graph(spark, d)).nodes.select("id")


@query("""with recursive walk(id, depth) as (select 'Region:1', 0 union select e.source, depth + 1 from walk join
(select 'Nation:' || n_nationkey as source, 'Region:' || n_regionkey as target from nation union all select 'Customer:' || c_custkey, 'Nation:' || c_nationkey from customer union all select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey from supplier) e
on e.target = walk.id where depth < 3) select id, min(depth) as depth from walk where depth > 0 group by id""")
def bounded_reach(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    return T.reachable(g, g.nodes("Region").where("id = 'Region:1'"), ("IN_NATION", "IN_REGION"), 3, "in")


@query("select 'Customer:' || c_custkey as id from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_acctbal < 0 and r_name = 'ASIA'")
def bounded_path(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    nodes = g.nodes("Customer").where("is_indebted")
    return T.with_bounded_path(nodes, g, ("IN_NATION", "IN_REGION"), 2, "Region", F.col("label") == "ASIA").select("id")


@query("""with recursive nxt as (select event_id, lead(event_id) over (partition by user_id order by ts, event_id) as n from events), walk(s, e, depth) as (select event_id, event_id, 0 from events where value > 300
union all select s, n, depth + 1 from walk join nxt on nxt.event_id = walk.e where n is not null and depth < 5) select 'Event:' || e as id, min(depth) as depth from walk where depth > 0 group by 1""")
def chain_reach(spark, d) -> DataFrame:
    g = event_graph(spark, d)
    return T.reachable(g, g.nodes("Event").where("value > 300"), ("NEXT_STEP",), 5)


@query("select c_name as c_label, o_orderpriority as o_priority, count(*) as n from customer join orders on o_custkey = c_custkey where c_acctbal < 0 and o_orderstatus = 'F' group by 1, 2")
def match_bindings(spark, d) -> DataFrame:
    text = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.is_indebted AND o.status = 'F' RETURN c.label, o.priority"
    return run.query(text, trade_graph(spark, d)).nodes.groupBy("c_label", "o_priority").agg(F.count("*").alias("n"))


@query("""select r_name as r_label, count(*) as n from (select distinct 'Nation' || n_nationkey as x, r_name from nation join region on r_regionkey = n_regionkey
union select 'Supplier' || s_suppkey, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey) group by 1""")
def match_variable_length(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    near = run.query("MATCH (n:Nation)-[:IN_NATION|IN_REGION*1..2]->(r:Region) RETURN n.id, r.label", g).nodes.withColumnRenamed("n_id", "x")
    far = run.query("MATCH (s:Supplier)-[:IN_NATION|IN_REGION*1..2]->(r:Region) RETURN s.id, r.label", g).nodes.withColumnRenamed("s_id", "x")
    return near.unionByName(far).groupBy("r_label").agg(F.count("*").alias("n"))


@query("select a.s_name as a_label, b.s_name as b_label from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey")
def match_pairs(spark, d) -> DataFrame:
    text = "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation), (n)<-[:IN_NATION]-(b:Supplier) WHERE a.id != b.id RETURN a.label, b.label"
    return run.query(text, trade_graph(spark, d)).nodes


@query("select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey <> b.p_partkey")
def shared_property_pairs(spark, d) -> DataFrame:
    p = trade_graph(spark, d).nodes("Part").select("key", "brand", "size")
    return T.paired(p, p, ["brand", "size"], "key").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


@query("select 'Supplier:' || s_suppkey as id from supplier where exists (select 1 from lineitem join orders on o_orderkey = l_orderkey where l_suppkey = s_suppkey and o_orderpriority = '1-URGENT' and o_totalprice > 495000)")
def edge_inward(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    return T.with_edge(g.nodes("Supplier"), g, T.Step("SHIPPED_BY", "in", "Order"), (F.col("priority") == "1-URGENT") & (F.col("totalprice") > 495000)).select("id")


@query("select 'Customer:' || c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def exists_patterns(spark, d) -> DataFrame:
    text = "FIND customers WHERE EXISTS (MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'P') AND NOT (c)-[:PLACED]->(:Order {priority: '1-URGENT'}) RETURN id"
    return run.query(text, trade_graph(spark, d)).nodes


@query("""select 'Customer:' || c_custkey as source, 'Part:' || l_partkey as target, 2 as depth, 'Customer:' || c_custkey || '>Order:' || o_orderkey || '>Part:' || l_partkey as path
from customer join orders on o_custkey = c_custkey join (select distinct l_orderkey, l_partkey from lineitem) l on l_orderkey = o_orderkey join part on p_partkey = l_partkey where c_acctbal < -900 and p_size >= 48""")
def flow_forward(spark, d) -> DataFrame:
    text = "FLOW FROM (c:Customer WHERE acctbal < -900) TO (p:Part WHERE size >= 48) VIA PLACED, CONTAINS_PART MAX DEPTH 2 RETURN PATHS"
    return run.query(text, trade_graph(spark, d)).nodes.withColumn("path", F.array_join("path", ">"))


@query("""select count(*) as n from customer join orders on o_custkey = c_custkey join (select distinct l_orderkey, l_partkey from lineitem) l on l_orderkey = o_orderkey join part on p_partkey = l_partkey
where c_acctbal < -900 and p_size >= 48 and o_orderstatus <> 'F' and c_name <> 'Customer#000000003'""")
def flow_unsafe(spark, d) -> DataFrame:
    """Paths that avoid sanitised nodes, here finished orders, and excluded sources."""
    g = trade_graph(spark, d)
    src = g.nodes("Customer").where("acctbal < -900 and label <> 'Customer#000000003'")
    return T.flow_paths(g, src, g.nodes("Part").where("size >= 48"), ("PLACED", "CONTAINS_PART"), 2, "out", g.nodes("Order").where("status = 'F'")).agg(F.count("*").alias("n"))


@query("""with o as (select distinct l_orderkey as k from lineitem join part on p_partkey = l_partkey where p_size >= 49 and p_brand = 'Brand#7')
select 'Order:' || k as id, 1 as depth from o union all select distinct 'Customer:' || o_custkey, 2 from orders join o on k = o_orderkey""")
def flow_influencers(spark, d) -> DataFrame:
    text = "FLOW BACKWARD TO (p:Part WHERE size >= 49 AND brand = 'Brand#7') VIA PLACED, CONTAINS_PART MAX DEPTH 2 RETURN INFLUENCERS"
    return run.query(text, trade_graph(spark, d)).nodes


@query("select 'Order:' || o_orderkey as id, 'Customer:' || o_custkey as owner from orders where o_totalprice > 490000")
def owner_lookup(spark, d) -> DataFrame:
    g = trade_graph(spark, d)
    return T.owners(g.nodes("Order").where("totalprice > 490000"), g.edges("PLACED")).select("id", "owner")


@query("""select l_linestatus, count(*) as n, round(sum(0.5 * (1 + least(l_discount, 1.0)) * case when l_returnflag = 'R' then 1.3 else 1.0 end * case when l_linestatus = 'F' then 0.7 else 1.0 end), 4) as weight from lineitem group by 1""")
def edge_weights(spark, d) -> DataFrame:
    w = T.edge_weights(trade_graph(spark, d).edges("CONTAINS_PART"))
    return w.groupBy(F.when(F.col("has_guard"), "F").otherwise("O").alias("l_linestatus")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query("select 'Order:' || l_orderkey || '->Part:' || l_partkey as edge_id, round(0.5 * (1 + arg_max(l_discount, l_linenumber * 1000 + l_discount)), 6) as weight from lineitem where l_linestatus = 'O' and l_returnflag = 'A' group by 1")
def batch_edge_weights(spark, d) -> DataFrame:
    line = read(spark, d, "lineitem").where("l_linestatus = 'O' and l_returnflag = 'A'")
    e = line.select(F.lit(None).cast("string").alias("id"), F.lit("uses").alias("type"), key("Order", "l_orderkey").alias("source"), key("Part", "l_partkey").alias("target"), F.col("l_discount").alias("risk_score"), (F.col("l_linenumber") * 1000 + F.col("l_discount")).alias("place"))
    return T.batch_weights(e, "place").select("edge_id", F.round("weight", 6).alias("weight"))


@query("""select source, round(sum(share), 6) as total, round(max(share), 6) as largest from (select l_orderkey as source, (1 + l_discount) / sum(1 + l_discount) over (partition by l_orderkey) as share from lineitem) group by 1""")
def weight_shares(spark, d) -> DataFrame:
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), (1 + F.col("l_discount")).alias("weight"))
    return T.normalised(e).groupBy("source").agg(F.round(F.sum("share"), 6).alias("total"), F.round(F.max("share"), 6).alias("largest"))


@query("select kind, t as type, (case when kind = 'dos' and t = 'has_loop' then 1.5 when t = 'has_loop' then 0.6 when kind = 'reentrancy' and t = 'delegatecall' then 2.5 when t = 'delegatecall' then 2.0 else 0.5 end)::double as weight from (values ('dos'), ('reentrancy')) a(kind), (values ('has_loop'), ('delegatecall'), ('other')) b(t)")
def analysis_weights(spark, d) -> DataFrame:
    types = spark.createDataFrame([("has_loop",), ("delegatecall",), ("other",)], "type string")
    out = [types.select(F.lit(k).alias("kind"), "type", T.base_weight(F.col("type"), T.analysis_weights(k)).alias("weight")) for k in ("dos", "reentrancy")]
    return out[0].unionByName(out[1])


_EDGES = """e as (select 'Customer:' || c_custkey as s, 'Nation:' || c_nationkey as t from customer union all select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey from supplier
union all select 'Nation:' || n_nationkey, 'Region:' || n_regionkey from nation union all select 'Nation:' || c_nationkey, 'Customer:' || c_custkey from customer where c_acctbal < 0)"""
_RANKS = ", ".join(
    f"""m{k} as (select t as id, sum(r * w) * 0.85 as r from n join r{k - 1} on id = s group by 1),
r{k} as (select id, sum(r) as r from (select * from m{k} union all select seed.id, seed.r * (1 - coalesce((select sum(r) from m{k}), 0)) from seed) group by 1)"""
    for k in range(1, 7)
)
_RANKED = f"""with {_EDGES}, n as (select s, t, count(*) / sum(count(*)) over (partition by s) as w from e group by s, t),
seed as (select 'Customer:' || c_custkey as id, 1.0 / count(*) over () as r from customer where c_acctbal > 9900), r0 as (select * from seed), {_RANKS}"""


def _ranks(g) -> DataFrame:
    """Six rounds over the edges of customers, suppliers, nations and regions."""
    edges = g.edges("IN_NATION", "IN_REGION").select("source", "target")
    back = g.edges("IN_NATION").join(g.nodes("Customer").where("is_indebted").select(F.col("id").alias("source")), "source", "left_semi")
    edges = edges.unionByName(back.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return T.personalised_pagerank(T.normalised(edges.withColumn("weight", F.lit(1.0))), g.nodes("Customer").where("acctbal > 9900").select("id"), iterations=6)


@query(f"{_RANKED} select id, round(r, 9) as rank from r6")
def pagerank(spark, d) -> DataFrame:
    return _ranks(trade_graph(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(f"{_RANKED} select 'node' as kind, id, null as target from r6 where r >= 0.002 union all select 'edge', s, t from (select distinct s, t from e) where s in (select id from r6 where r >= 0.002) and t in (select id from r6 where r >= 0.002) and (s like 'Customer:%' or s like 'Supplier:%' or (s like 'Nation:%' and t like 'Region:%'))")
def seeded_subgraph(spark, d) -> DataFrame:
    """Seeds, their personalised ranks, and the graph between the nodes that rank high."""
    g = trade_graph(spark, d)
    small = type(g)({t: g.node_tables[t] for t in ("Customer", "Supplier", "Nation", "Region")}, {t: g.edge_tables[t] for t in ("IN_NATION", "IN_REGION")})
    nodes, edges = T.ranked_subgraph(small, _ranks(g), 0.002)
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("target")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "target").distinct())


def work_log(spark, d) -> DataFrame:
    """Orders as an append-only log: two lines for each item, the later with its state."""
    o = read(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("open")
    base = o.select(
        F.col("o_orderkey").cast("string").alias("id"), state.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("parent_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array()).otherwise(F.array((F.col("o_orderkey") - 1).cast("string"))).alias("blockers"), F.when(F.col("o_orderkey") % 2 == 0, "unassigned").otherwise("p1").alias("pool"),
    )
    first = base.withColumn("status", F.lit("open")).withColumn("log_pos", F.col("id").cast("bigint") * 2)
    return first.unionByName(base.withColumn("log_pos", F.col("id").cast("bigint") * 2 + 1))


@query("""select case o_orderstatus when 'F' then 'complete' when 'P' then 'in_progress' else 'open' end as status, count(*) as n from orders group by 1""")
def log_state(spark, d) -> DataFrame:
    return overlay.current(work_log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("""select cast(o_orderkey as varchar) as id from orders o where o_orderstatus = 'O' and (o_orderkey % 3 = 0 or exists (select 1 from orders b where b.o_orderkey = o.o_orderkey - 1 and b.o_orderstatus = 'F'))""")
def ready_items(spark, d) -> DataFrame:
    return overlay.ready(overlay.current(work_log(spark, d))).select("id")


@query("select cast(o_orderkey as varchar) as id, cast(substr(o_orderpriority, 1, 1) as int) as priority from orders where o_orderstatus = 'P' order by 2, strftime(o_orderdate, '%Y-%m-%d'), 1")
def item_filter(spark, d) -> DataFrame:
    return overlay.chosen(overlay.current(work_log(spark, d)), status="in_progress").select("id", "priority")


@query("select '42' as id, 'unassigned' as pool")
def item_lookup(spark, d) -> DataFrame:
    items = overlay.current(work_log(spark, d))
    both = items.unionByName(items.where("id = '42'").withColumn("pool", F.lit("p9")))
    return overlay.find_item(both, "42").select("id", "pool")


@query("""select page_id, coalesce((select arg_max(r, length(r)) from (values ('0'), ('25'), ('125'), ('x'), ('ref=x')) t(r) where ends_with(url, r)), split_part(url, '.', -1)) as rule_id from pages""")
def rule_resolution(spark, d) -> DataFrame:
    pages = read(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    rules = spark.createDataFrame([("0",), ("25",), ("125",), ("x",), ("ref=x",)], "id string")
    return dedup.resolve_rule(pages, rules, "url").select(F.col("id").alias("page_id"), "rule_id")


_CLUSTERS = """(select user_id, event_type, value, cast(sum(case when g is null or g > 21600 then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) as bigint) as cluster from
(select *, s - lag(s) over (partition by user_id order by s, event_id) as g from (select *, epoch_us(ts) // 1000000 as s from events)))"""


def event_clusters(spark, d) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("line"))
    return dedup.line_clusters(e, ["user_id"], "line", 21600)


@query(f"select user_id, cluster, count(*) as n from {_CLUSTERS} group by 1, 2")
def finding_clusters(spark, d) -> DataFrame:
    return event_clusters(spark, d).groupBy("user_id", "cluster").agg(F.count("*").alias("n"))


@query(f"""select user_id, cluster, count(*) as findings, count(distinct event_type) as tools, round(least(1.0, max(value / 500) + case when count(distinct event_type) >= 3 then 0.2 when count(distinct event_type) = 2 then 0.1 else 0 end), 6) as boosted from {_CLUSTERS} group by 1, 2""")
def agreement_boost(spark, d) -> DataFrame:
    m = dedup.merged(event_clusters(spark, d).withColumn("confidence", F.col("value") / 500), ["user_id"], "event_type", "confidence")
    return m.select("user_id", "cluster", "findings", "tools", F.round("boosted", 6).alias("boosted"))


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id
where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) > 0.4""")
def embedding_merge(spark, d) -> DataFrame:
    return dedup.alike(read(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.4).select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("""select brand, precision from (select p_brand as brand, max(p_size) / 50.0 as precision from part where p_size < 45 group by 1) where precision >= 0.88 and brand not in ('Brand#3', 'Brand#7')""")
def skippable_patterns(spark, d) -> DataFrame:
    part = read(spark, d, "part")
    cover = part.where("p_size < 45").select(F.col("p_brand").alias("pattern_id"), (F.col("p_size") / 50.0).alias("precision"))
    got = dedup.skippable(part.select(F.col("p_brand").alias("pattern_id")).distinct(), cover, ["Brand#3", "Brand#7"], 0.88)
    return got.select(F.col("pattern_id").alias("brand"), "precision")


@query("select p_type as detector, pattern_id, count(*) as n from part left join (values ('PROMO', 'p-1'), ('SMALL', 'p-2')) m(t, pattern_id) on t = p_type group by 1, 2")
def detector_mapping(spark, d) -> DataFrame:
    mapping = spark.createDataFrame([("PROMO", "p-1", 0.1), ("SMALL", "p-2", 0.2)], "detector string, pattern_id string, boost double")
    got = dedup.mapped(read(spark, d, "part").select(F.col("p_type").alias("detector")), mapping)
    return got.groupBy("detector", "pattern_id").agg(F.count("*").alias("n"))


#: Rounds that the SQL unrolls: in each, pairs that are the first of both their sides.
_ROUNDS = ", ".join(
    f"""t{k} as (select a, b, d from (select *, row_number() over (partition by a order by d, a, b) as x, row_number() over (partition by b order by d, a, b) as y from p{k}) where x = 1 and y = 1),
p{k + 1} as (select * from p{k} where a not in (select a from t{k}) and b not in (select b from t{k}))"""
    for k in range(12)
)


@query(f"""with f as (select event_id, user_id, epoch_us(ts) // 3600000000 as line from events where event_type = 'click'), t as (select event_id, user_id, epoch_us(ts) // 3600000000 as line from events where event_type = 'purchase'),
p0 as (select f.event_id as a, t.event_id as b, abs(f.line - t.line) as d from f join t on f.user_id = t.user_id and abs(f.line - t.line) <= 10), {_ROUNDS}
select a as finding_id, b as truth_id, d as distance from ({" union all ".join(f"select * from t{k}" for k in range(12))})""")
def truth_match(spark, d) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("line"))
    return evaluate.match_truth(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "line")


@query("""with s as (select distinct l_orderkey as i, l_partkey as t from lineitem), n as (select i, count(*) as n from s group by 1), c as (select a.i as a, b.i as b, count(*) as c from s a join s b on a.t = b.t and a.i < b.i group by 1, 2)
select a, b, round(c / (x.n + y.n - c), 6) as jaccard from c join n x on x.i = a join n y on y.i = b where c / (x.n + y.n - c) >= 0.5""")
def operation_similarity(spark, d) -> DataFrame:
    sets = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("x"))
    return dedup.jaccard_pairs(sets, "l_orderkey", "x", 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
