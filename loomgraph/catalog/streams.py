"""Event-time windows, health, alerts, differences; as batches, which the same functions take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.catalog import query
from loomgraph.model import read
from loomgraph.streaming import monitor


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H') as w, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def tumbling_windows(spark, d) -> DataFrame:
    w = monitor.tumbling(monitor.timed(read(spark, d, "events")), "1 hour", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 3)})
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("w"), "event_type", "n", "total")


@query("""select strftime(w, '%Y-%m-%d %H:%M') as w, count(*) as n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as w from events) group by 1""")
def sliding_windows(spark, d) -> DataFrame:
    w = monitor.tumbling(monitor.timed(read(spark, d, "events")), "1 hour", [], {"n": F.count("*")}, slide="30 minutes")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w"), "n")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as s from events), x as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as session_start, count(*) as n from x group by user_id, k""")
def session_windows(spark, d) -> DataFrame:
    s = monitor.sessions(monitor.timed(read(spark, d, "events")), "user_id", "6 hours", {"n": F.count("*")})
    return s.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@query("""select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as w, count(*) as events, round(greatest(100 - 50.0 * count(*) filter (event_type = 'error') / count(*) - 30.0 * count(*) filter (value > 150) / count(*) - case when count(*) < 1 then 20.0 else 0 end, 0), 6) as score from events group by 1""")
def health_scores(spark, d) -> DataFrame:
    h = monitor.health(monitor.timed(read(spark, d, "events")), "1 day", [], F.col("event_type") == "error", F.col("value") > 150)
    return h.select(F.date_format("window_start", "yyyy-MM-dd").alias("w"), "events", F.round("score", 6).alias("score"))


@query("""select rule, severity, count(*) as n from (select 'error' as rule, 'critical' as severity from events where event_type = 'error' union all select 'large', 'warning' from events where value > 200) group by 1, 2""")
def event_alerts(spark, d) -> DataFrame:
    rules = [monitor.AlertRule("error", F.col("event_type") == "error", "critical"), monitor.AlertRule("large", F.col("value") > 200)]
    return monitor.alerts(read(spark, d, "events"), rules).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("""with recursive e as (select user_id, epoch_us(ts) as t from events where event_type = 'error'), c(user_id, first) as (select user_id, min(t) from e group by user_id
union all select c.user_id, min(e.t) from c join e on e.user_id = c.user_id and e.t >= c.first + 86400000000 group by c.user_id, c.first),
n as (select *, lead(first) over (partition by user_id order by first) as next from c) select n.user_id, n.first, count(*) as alerts from n join e on e.user_id = n.user_id and e.t >= n.first and (n.next is null or e.t < n.next) group by 1, 2""")
def alert_cooldown(spark, d) -> DataFrame:
    c = monitor.cooled(read(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", 86400)
    return c.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("first"), "alerts")


@query("""select change, count(*) as n from (select case when a is null then 'added' when b is null then 'removed' when v <> w then 'modified' end as change from (select c_custkey as a, c_acctbal as v from customer where c_nationkey < 20) full join
(select c_custkey as b, case when c_mktsegment = 'BUILDING' then 0.0 else c_acctbal end as w from customer where c_nationkey >= 5) on a = b) where change is not null group by 1""")
def incremental_diff(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    new = c.where("c_nationkey >= 5").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", 0.0).otherwise(F.col("c_acctbal")))
    return monitor.difference(c.where("c_nationkey < 20"), new, "c_custkey", ["c_acctbal"]).groupBy("change").agg(F.count("*").alias("n"))


@query("select count(*) as n from orders where o_orderstatus <> 'F'")
def changed_rows(spark, d) -> DataFrame:
    o = read(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    cols = ["o_orderkey", "o_totalprice", "o_orderdate"]
    known = o.where("o_orderstatus = 'F'").select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("content_hash"))
    return monitor.changed(o, known, cols).agg(F.count("*").alias("n"))


@query("""select user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) as duration, string_agg(distinct event_type, ',' order by event_type) as agent_types, count(distinct value) as agents, count(*) filter (event_type = 'purchase') as completed from events group by 1""")
def stream_statistics(spark, d) -> DataFrame:
    e = read(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.col("event_type").alias("agent_type"), F.col("value").alias("agent_id"), F.when(F.col("event_type") == "purchase", "task_completed").otherwise("x").alias("type"))
    return monitor.stream_statistics(e, ["user_id"]).select("user_id", F.round("duration", 3).alias("duration"), F.array_join("agent_types", ",").alias("agent_types"), "agents", "completed")
