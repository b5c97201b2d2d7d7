"""Files and logs that are written to the shared folder and read again; rule mutations and taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.catalog import query
from loomgraph.catalog.graph import work_log
from loomgraph.catalog.predicates import sample_rules
from loomgraph.model import read, trade_graph
from loomgraph.operators import overlay, risk, rules
from loomgraph.scratch import folder
from loomgraph.sources import files


def _one_document(rows: DataFrame, name: str, path: str) -> None:
    """Each file of path holds one JSON document {name: [...]}, with the rows of a group g."""
    fields = F.struct(*(c for c in rows.columns if c != "g"))
    rows.groupBy("g").agg(F.to_json(F.struct(F.collect_list(fields).alias(name))).alias("value")).repartition(8, "g").write.partitionBy("g").text(path)


@query("""select kind, count(*) as n, count(distinct id) as ids from (select 'Region' as kind, 'Region:' || r_regionkey as id from region union all select 'Nation', 'Nation:' || n_nationkey from nation union all select 'IN_REGION', 'Nation:' || n_nationkey || '->Region:' || n_regionkey from nation) group by 1""")
def graph_artefact(spark, d) -> DataFrame:
    """A JSON graph of regions and nations, found by its stem and read with its types."""
    g, at = trade_graph(spark, d), folder(spark, "graph")
    nodes = g.nodes("Region", "Nation").select("id", "type", "label", F.create_map(F.lit("key"), F.col("key").cast("string")).alias("properties"))
    edges = g.edges("IN_REGION").select("id", "type", "source", "target")
    meta = spark.createDataFrame([("1", "h", "2024", "trade")], files.META_SCHEMA)
    packed = nodes.agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes")).crossJoin(edges.agg(F.collect_list(F.struct(*edges.columns)).alias("edges"))).crossJoin(meta.select(F.struct(*meta.columns).alias("metadata")))
    packed.select(F.to_json(F.struct("nodes", "edges", "metadata")).alias("value")).coalesce(1).write.text(f"{at}/trade.json")
    known = spark.createDataFrame([(f"{at}/trade.json", "trade"), (f"{at}/other.json", "other")], "path string, stem string")
    nodes, edges, _ = files.read_graph_json(spark, files.resolve_graph(known, "trade"))
    both = files.promote(nodes, {"key": "bigint"}).where("key is not null").select("type", "id").unionByName(edges.select("type", "id"))
    return both.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("select 'Customer' as type, count(*) as n from customer where c_acctbal < 0 union all select 'PLACED', count(*) from orders")
def graph_tables(spark, d) -> DataFrame:
    """The native artefact: Parquet by type, of which a typed scan reads its folders only."""
    g, at = trade_graph(spark, d), folder(spark, "tables")
    small = type(g)({t: g.node_tables[t] for t in ("Customer", "Nation")}, {t: g.edge_tables[t] for t in ("PLACED", "IN_REGION")})
    files.graph_tables(small, at)
    back = files.read_graph_tables(spark, at, ["Customer", "Nation"], ["PLACED", "IN_REGION"])
    return back.nodes("Customer").where("is_indebted").groupBy("type").agg(F.count("*").alias("n")).unionByName(back.edges("PLACED").groupBy("type").agg(F.count("*").alias("n")))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type as metric, count(*) as n, round(sum(value), 3) as total from events where ts >= timestamp '2024-01-10' group by 1, 2")
def snapshot_files(spark, d) -> DataFrame:
    """Metric points written by day in two runs, those before a date dropped, and read again."""
    at = folder(spark, "snapshots")
    points = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value", (F.col("event_id") % 2).alias("run_id"))
    kept, _ = files.retain(points, F.lit("2024-01-31").cast("timestamp"), 21)
    for run_id in (0, 1):
        files.write_snapshots(kept.where(F.col("run_id") == run_id), at)
    back = spark.read.parquet(at)
    return back.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""select 'scan' as tool, 'c-' || page_id % 5 as check_id, case page_id % 4 when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'INFO' else 'CRITICAL' end as severity, count(*) as n, cast(sum(page_id) as bigint) as lines from pages group by all
union all select 'probe', 'c-' || page_id % 5, case page_id % 4 when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'INFO' else 'CRITICAL' end, count(*), cast(sum(page_id) as bigint) from pages where page_id % 3 = 0 group by all""")
def tool_reports(spark, d) -> DataFrame:
    """Reports of one tool's own form and of the exchange form, as findings on one scale."""
    at, k = folder(spark, "reports"), F.col("page_id")
    level = F.element_at(F.array(*map(F.lit, ("error", "warning", "note", "4"))), (k % 4 + 1).cast("int"))
    line = k.cast("int")
    own = read(spark, d, "pages").select((k % 8).alias("g"), F.concat(F.lit("c-"), (k % 5).cast("string")).alias("check_id"), F.col("url").alias("path"), F.struct(line.alias("line")).alias("start"), F.struct(line.alias("line")).alias("end"), F.struct(F.lit("m").alias("message"), level.alias("severity"), F.lit("x").alias("lines")).alias("extra"), "page_id", level.alias("level"))
    _one_document(own.drop("page_id", "level"), "results", f"{at}/own")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("check_id").alias("ruleId"), "level", F.struct(F.lit("m").alias("text")).alias("message"), F.array(place).alias("locations"))
    runs = own.where("page_id % 3 = 0").groupBy("g").agg(F.collect_list(result).alias("results")).select("g", F.struct(F.struct(F.lit("probe").alias("name")).alias("driver")).alias("tool"), "results")
    _one_document(runs, "runs", f"{at}/sarif")
    a = files.tool_findings(spark, f"{at}/own").select(F.lit("scan").alias("tool"), "check_id", "severity", "line_start")
    b = files.sarif_findings(spark, f"{at}/sarif").select("tool", "check_id", "severity", "line_start")
    return a.unionByName(b).groupBy("tool", "check_id", "severity").agg(F.count("*").alias("n"), F.sum("line_start").alias("lines"))


@query("select case o_orderstatus when 'F' then 'complete' when 'P' then 'in_progress' else 'open' end as status, count(*) as n from orders where o_orderkey % 3 = 0 group by 1 union all select 'open late', count(*) from orders where o_orderkey % 3 = 0 and o_orderkey % 2 = 0")
def appended_log(spark, d) -> DataFrame:
    """Work items appended to a JSON-lines log in three writes; the last line of an item is its state."""
    at = folder(spark, "log")
    log = work_log(spark, d).where("cast(id as bigint) % 3 = 0").select("log_pos", "id", "status", "priority", "created_at")
    files.append_log(log.where("log_pos % 2 = 0"), at)
    files.append_log(log.where("log_pos % 2 = 1"), at)
    once = overlay.current(files.read_log(spark, at)).groupBy("status").agg(F.count("*").alias("n"))
    later = log.where("cast(id as bigint) % 2 = 0 and log_pos % 2 = 1").withColumns({"log_pos": F.col("log_pos") + (1 << 40), "status": F.lit("open late")})
    both = folder(spark, "log")
    files.append_log(files.read_log(spark, at), both)
    files.append_log(later, both)
    after = overlay.current(files.read_log(spark, both)).where("status = 'open late'").groupBy("status").agg(F.count("*").alias("n"))
    return once.unionByName(after)


@query("""select 'large-part~drop is_large' as pattern_id, count(*) as n from part where p_type = 'PROMO' or regexp_matches(p_name, 'ring$') union all select 'large-part~flip is_large', count(*) from part where p_size < 40 and (p_type = 'PROMO' or regexp_matches(p_name, 'ring$'))
union all select 'size~drop size', count(*) from part union all select 'size~flip size', count(*) from part where p_size < 20 union all select 'size~size * 1.5', count(*) from part where p_size >= 30""")
def rule_mutations(spark, d) -> DataFrame:
    """What single changes of a rule's required conditions would find."""
    sized = rules.rule_from({"id": "size", "scope": "Part", "severity": "low", "match": {"all": [{"property": "size", "op": "gte", "value": 20}]}})
    changed = [m for r in (*(r for r in sample_rules() if r.id == "large-part"), sized) for m in rules.mutations(r, 1.5)]
    return rules.run_rules(trade_graph(spark, d), changed).groupBy("pattern_id").agg(F.count("*").alias("n"))


@query("""with recursive p(c, a) as (values ('click', 'use'), ('view', 'use'), ('purchase', 'money'), ('use', 'all'), ('money', 'all'), ('error', 'fault')), up(x, a) as (select event_type, event_type from (select distinct event_type from events) union select up.x, p.a from up join p on p.c = up.a)
select a as tag, count(*) as n from up join events on event_type = x group by 1""")
def taxonomy_rollup(spark, d) -> DataFrame:
    """Counts of tags with all that stands below them in a hierarchy."""
    parents = spark.createDataFrame([("click", "use"), ("view", "use"), ("purchase", "money"), ("use", "all"), ("money", "all"), ("error", "fault")], "tag string, parent string")
    return risk.rollup(read(spark, d, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n")), parents, "n")


@query("""with h as (select o_orderpriority as p, o_custkey % 50 as w, o_orderstatus = 'F' as fp from orders where o_orderkey % 2 = 0), e as (select p, w, count(*) as n, avg(fp::int) as r from h group by 1, 2), g as (select p, avg(fp::int) as r from h group by 1)
select f.p as pattern, case when e.n >= 3 then 'place' when g.p is not null then 'pattern' else 'none' end as tier, count(*) as n, round(sum(case when e.n >= 3 then e.r else coalesce(g.r, 0) end), 4) as expected
from (select o_orderpriority as p, o_custkey % 50 as w from orders where o_orderkey % 2 = 1) f left join e on e.p = f.p and e.w = f.w left join g on g.p = f.p group by 1, 2""")
def learned_rates(spark, d) -> DataFrame:
    """The false-positive rate that past verdicts give a finding: of its place, else of its pattern."""
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("pattern"), (F.col("o_custkey") % 50).alias("place"), (F.col("o_orderstatus") == "F").alias("false_positive"), "o_orderkey")
    got = risk.learned_rate(o.where("o_orderkey % 2 = 1").select("pattern", "place"), o.where("o_orderkey % 2 = 0"), ["pattern", "place"], least=3)
    return got.groupBy("pattern", "tier").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 4).alias("expected"))
