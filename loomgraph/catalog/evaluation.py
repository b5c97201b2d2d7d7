"""Aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.catalog import query
from loomgraph.functions import confidence as C
from loomgraph.functions import costs, metrics
from loomgraph.model import read
from loomgraph.operators import evaluate, overlay, scores


@query("""select c_nationkey, count(*) as members, count(*) filter (c_mktsegment = 'BUILDING') as builders, count(*) filter (c_mktsegment = 'MACHINERY') as makers, bool_or(c_acctbal < 0) as any_debt, bool_or(c_acctbal > 9990) as any_rich,
case when count(*) < 20 then 'small' when count(*) < 50 then 'medium' when count(*) < 100 then 'large' else 'very_large' end as size_band from customer group by 1""")
def group_analysis(spark, d) -> DataFrame:
    counts = {"builders": F.col("c_mktsegment") == "BUILDING", "makers": F.col("c_mktsegment") == "MACHINERY"}
    flags = {"any_debt": F.col("c_acctbal") < 0, "any_rich": F.col("c_acctbal") > 9990}
    return evaluate.group_profile(read(spark, d, "customer"), "c_nationkey", counts, flags)


def challenge_results(spark, d) -> DataFrame:
    """Orders as challenges: status by order status, counts from the lines."""
    line = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").cast("int").alias("expected"), F.count_if(F.col("l_returnflag") == "R").cast("int").alias("actual"), F.collect_list(F.when(F.col("l_tax") > 0.07, "x")).alias("false_positives"))
    state = F.when(F.col("o_orderstatus") == "F", "detected").when(F.col("o_orderstatus") == "P", "not-detected").when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("error")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", state.alias("status"))
    return o.join(line, "k", "left").select(F.col("k").alias("challenge_id"), "o_orderpriority", "status", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("false_positives", F.array().cast("array<string>")).alias("false_positives"))


_RESULTS = """(select o_orderkey as k, o_orderpriority, case when o_orderstatus = 'F' then 'detected' when o_orderstatus = 'P' then 'not-detected' when o_orderpriority = '5-LOW' then 'skipped' else 'error' end as status,
coalesce(e, 0) as e, coalesce(a, 0) as a, coalesce(f, 0) as f from orders left join (select l_orderkey, count(*) as e, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_tax > 0.07) as f from lineitem group by 1) on l_orderkey = o_orderkey)"""


@query(f"""select o_orderpriority, count(*) as total, count(*) filter (status = 'detected') as detected, round(coalesce(count(*) filter (status = 'detected') / nullif(count(*) filter (status <> 'skipped'), 0), 0), 6) as detection_rate,
round(avg(case when status <> 'skipped' then case when e = 0 then 1.0 else a / e end end), 6) as avg_recall, cast(sum(f) as bigint) as false_positives from {_RESULTS} group by 1""")
def challenge_rates(spark, d) -> DataFrame:
    r = evaluate.challenge_rates(challenge_results(spark, d), ["o_orderpriority"])
    return r.withColumns({"detection_rate": F.round("detection_rate", 6), "avg_recall": F.round("avg_recall", 6)})


@query(f"select count(*) filter (s <> 'not-applicable') as detectable, count(*) filter (s = 'detected') as detected, round(count(*) filter (s = 'detected') / count(*) filter (s <> 'not-applicable'), 6) as rate from (select case when status = 'skipped' then 'not-applicable' else status end as s from {_RESULTS})")
def declared_rate(spark, d) -> DataFrame:
    s = challenge_results(spark, d).withColumn("status", F.when(F.col("status") == "skipped", "not-applicable").otherwise(F.col("status")))
    return evaluate.declared_rate(s).withColumn("rate", F.round("rate", 6))


@query(f"""select change, count(*) as n from (select case when b is null then 'improved' when status = 'detected' and b <> 'detected' then 'improved' when status <> 'detected' and b = 'detected' then 'regressed' else 'unchanged' end as change
from (select r.status, case o_orderpriority when '1-URGENT' then null when '2-HIGH' then 'detected' else r.status end as b from {_RESULTS} r)) group by 1""")
def suite_comparison(spark, d) -> DataFrame:
    now = challenge_results(spark, d)
    base = now.where("o_orderpriority <> '1-URGENT'").withColumn("status", F.when(F.col("o_orderpriority") == "2-HIGH", "detected").otherwise(F.col("status")))
    return evaluate.compare_runs(now, base).groupBy("change").agg(F.count("*").alias("n"))


@query("""with c as (select c_mktsegment as k, round(avg(c_acctbal) / 10000, 6) as v from customer where c_nationkey <= 12 and c_mktsegment <> 'BUILDING' group by 1), b as (select c_mktsegment as k, round(avg(c_acctbal) / 10000, 6) as v from customer where c_nationkey > 12 group by 1)
select coalesce(c.k, b.k) as k, coalesce(c.v, 0) as current, coalesce(b.v, 0) as baseline, round(coalesce(c.v, 0) - coalesce(b.v, 0), 6) as delta, coalesce(c.v, 0) - coalesce(b.v, 0) >= -0.05 as passed from c full join b on c.k = b.k""")
def metric_regression(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    mean = lambda x: x.groupBy(F.col("c_mktsegment").alias("k")).agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("v"))
    r = evaluate.regression(mean(c.where("c_nationkey <= 12 and c_mktsegment <> 'BUILDING'")), mean(c.where("c_nationkey > 12")), "k", "v")
    return r.withColumn("delta", F.round("delta", 6))


def detections(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("event_type").alias("pattern_id"), (F.col("value") > 50).alias("expected"), (F.col("user_id") % 3 != 0).alias("detected"), "user_id", "value")


@query("""with e as (select event_type as p, value > 50 as x, user_id % 3 <> 0 as y from events), g as (select p, count(*) filter (x and y) as tp, count(*) filter (not x and y) as fp, count(*) filter (x) as ex from e group by 1)
select round(sum(tp) / sum(ex), 6) as detection_rate, round(sum(fp) / (sum(fp) + sum(tp)), 6) as false_positive_rate, round(avg(tp / (tp + fp)), 6) as pattern_precision from g""")
def detection_indicators(spark, d) -> DataFrame:
    m = metrics.detection_indicators(detections(spark, d))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("select case when value > 50 and user_id % 3 <> 0 then 'TP' when user_id % 3 <> 0 then 'FP' when value > 50 then 'FN' else 'TN' end as outcome, count(*) as n from events group by 1")
def outcome_counts(spark, d) -> DataFrame:
    return detections(spark, d).groupBy(metrics.outcome(F.col("expected"), F.col("detected")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""with p as (select event_type as m, avg(value) / 100 as v from events group by 1) select m, case when v >= 0.50 then 'ok' when v >= 0.45 then 'warning' else 'critical' end as up, case when v <= 0.45 then 'ok' when v <= 0.50 then 'warning' else 'critical' end as down from p""")
def metric_status(spark, d) -> DataFrame:
    p = read(spark, d, "events").groupBy(F.col("event_type").alias("m")).agg((F.avg("value") / 100).alias("v"))
    s = lambda target, warn, up: metrics.status(F.col("v"), F.lit(target), F.lit(warn), F.lit(up))
    return p.select("m", s(0.50, 0.45, True).alias("up"), s(0.45, 0.50, False).alias("down"))


@query("select s as status, coalesce(n, 0) as n from (values ('F'), ('O'), ('P'), ('X')) t(s) left join (select o_orderstatus, count(*) as n from orders group by 1) on o_orderstatus = s")
def status_histogram(spark, d) -> DataFrame:
    return metrics.histogram(read(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


@query("select bool_or(o_orderstatus = 'O') as any_warning, bool_or(o_orderstatus = 'P') as any_critical, not bool_or(o_orderstatus = 'P') as passed from orders")
def metrics_gate(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "warning").when(F.col("o_orderstatus") == "P", "critical").otherwise("ok").alias("status"))
    return metrics.gate(o)


@query("""select event_type as metric, min(value) as min, max(value) as max, round(avg(value), 6) as avg, arg_max(value, ts) as latest, count(*) as count from events where ts >= timestamp '2024-01-15' group by 1""")
def metric_history(spark, d) -> DataFrame:
    pts = read(spark, d, "events").select(F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"))
    return metrics.history_statistics(pts, F.lit("2024-01-15").cast("timestamp")).withColumn("avg", F.round("avg", 6))


@query("select * from (values ('detection_rate'), ('false_positive_rate'), ('pattern_precision'), ('time_to_detection'), ('scaffold_compile_rate'), ('escalation_rate')) t(metric)")
def available_metrics(spark, d) -> DataFrame:
    return metrics.available(metrics.definitions(spark), [metrics.WORK]).select("metric")


@query("""with p as (select n_regionkey, count(*) filter (c_acctbal > 0) as tp, count(*) filter (c_acctbal < 0) as fp, count(*) filter (c_mktsegment = 'BUILDING') as fn from customer join nation on n_nationkey = c_nationkey group by 1),
s as (select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from p) select tp, fp, fn, round_even(tp / (tp + fp), 4) as precision, round_even(tp / (tp + fn), 4) as recall, round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) as f1 from s""")
def micro_scores(spark, d) -> DataFrame:
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy("n_regionkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("tp"), F.count_if(F.col("c_acctbal") < 0).alias("fp"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("fn"))
    return evaluate.micro_scores(p)


@query("""select count(*) as total, count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed, round(sum(value) filter (event_type <> 'error'), 3) as sum_seconds, round(avg(value) filter (event_type <> 'error'), 6) as avg_seconds,
min(value) filter (event_type <> 'error') as min_seconds, max(value) filter (event_type <> 'error') as max_seconds from events""")
def run_summary(spark, d) -> DataFrame:
    e = read(spark, d, "events").select((F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"), F.col("value").alias("memory"))
    s = evaluate.run_summary(e)
    return s.select("total", "succeeded", "failed", F.round("sum_seconds", 3).alias("sum_seconds"), F.round("avg_seconds", 6).alias("avg_seconds"), "min_seconds", "max_seconds")


@query("""with x as (select p_brand as b, p_partkey as k from part), e as (select distinct l_partkey as k from lineitem where l_discount >= 0.1 and l_quantity >= 49) select b, count(*) as expected, count(e.k) as covered, round_even(count(e.k) / count(*), 3) as share,
coalesce(string_agg(cast(case when e.k is null then x.k end as varchar), ',' order by x.k), '') as missing from x left join e on e.k = x.k group by 1""")
def coverage_map(spark, d) -> DataFrame:
    expected = read(spark, d, "part").select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("k"))
    seen = read(spark, d, "lineitem").where("l_discount >= 0.1 and l_quantity >= 49").select(F.col("l_partkey").alias("k"))
    return evaluate.coverage(expected, seen, "k", "b").withColumn("missing", F.array_join(F.transform("missing", lambda m: m.cast("string")), ","))


@query("select event_type, count(*) as n, round(stddev_pop(value) / avg(value), 6) as cv, round(max(value) - min(value), 6) as spread, stddev_pop(value) / avg(value) <= 1.0 as passed from events group by 1")
def variance_gate(spark, d) -> DataFrame:
    g = evaluate.variance_gate(read(spark, d, "events"), "event_type", "value", 1.0)
    return g.withColumns({"cv": F.round("cv", 6), "spread": F.round("spread", 6)})


@query("with e as (select l_partkey, count(distinct l_returnflag) as n from lineitem where l_quantity > 40 group by 1) select count(*) filter (n = 3) as common, count(*) as any, round(count(*) filter (n = 3) / count(*), 6) as jaccard from e")
def agreement(spark, d) -> DataFrame:
    return evaluate.agreement(read(spark, d, "lineitem").where("l_quantity > 40"), "l_partkey", "l_returnflag", 3).withColumn("jaccard", F.round("jaccard", 6))


@query("""with g as (select event_type, count(*) filter (value > 50 and user_id % 3 <> 0) as tp, count(*) filter (value <= 50 and user_id % 3 = 0) as tn, count(*) filter (value <= 50 and user_id % 3 <> 0) as fp, count(*) filter (value > 50 and user_id % 3 = 0) as fn from events group by 1)
select *, tp + tn - 2 * fp - 2 * fn as score, tp + tn - 2 * fp - 2 * fn >= 0 and fp <= 0 and fn <= 0 as passed, fp = 0 and fn = 0 as suspicious from g""")
def gauntlet_score(spark, d) -> DataFrame:
    e = read(spark, d, "events").select("event_type", (F.col("value") > 50).alias("vulnerable"), (F.col("user_id") % 3 != 0).alias("flagged"))
    return evaluate.gauntlet(e, ["event_type"])


@query("""select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M') as w, count(*) as n, round(quantile_cont(value, 0.95), 6) as p95, case when quantile_cont(value, 0.95) > 150 then 'alert' when quantile_cont(value, 0.95) > 100 then 'missed' else 'met' end as slo from events group by 1""")
def slo_windows(spark, d) -> DataFrame:
    s = evaluate.slo_windows(read(spark, d, "events"), "ts", "value", target=100, alert=150)
    return s.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w"), "n", F.round("p95", 6).alias("p95"), "slo")


@query("select event_type, count(*) as query_count, count(distinct user_id) as unique_nodes, round(sum(value), 3) as seconds from events group by 1")
def graph_usage(spark, d) -> DataFrame:
    log = read(spark, d, "events").select("event_type", F.col("user_id").alias("node_id"), F.col("value").alias("seconds"))
    return evaluate.usage(log, ["event_type"]).withColumn("seconds", F.round("seconds", 3))


@query("""select c_mktsegment, c_nationkey, count(*) as total, count(*) filter (c_acctbal > 0) as detectable, round(count(*) filter (c_acctbal > 0) / count(*), 6) as share from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())""")
def truth_coverage(spark, d) -> DataFrame:
    t = read(spark, d, "customer").withColumn("detectable", F.col("c_acctbal") > 0)
    return evaluate.truth_coverage(t, ["c_mktsegment", "c_nationkey"]).withColumn("share", F.round("share", 6))


@query("select p_brand, count(*) as findings, count(distinct p_type) as sources, count(*) >= 80 and count(distinct p_type) >= 5 as passed from part group by 1")
def truth_gate(spark, d) -> DataFrame:
    return evaluate.truth_gate(read(spark, d, "part"), "p_brand", "p_type", 80, 5)


@query("""with c as (select o_orderstatus as type, count(*) as n from orders where o_orderpriority <> '1-URGENT' or o_orderstatus = 'F' group by 1), b as (select o_orderstatus as type, count(*) as n0 from orders group by 1)
select coalesce(c.type, b.type) as type, coalesce(n, 0) as n, coalesce(n0, 0) as n0, abs(coalesce(n, 0) - coalesce(n0, 0)) <= coalesce(n0, 0) * 0.3 as passed from c full join b on c.type = b.type""")
def build_gate(spark, d) -> DataFrame:
    o = read(spark, d, "orders").withColumn("type", F.col("o_orderstatus"))
    return evaluate.build_gate(o.where("o_orderpriority <> '1-URGENT' or o_orderstatus = 'F'"), o)


@query("select count(*) filter (b is null) as added, count(*) filter (c is null) as removed, count(*) as ids, round((count(*) filter (b is null) + count(*) filter (c is null)) / count(*), 6) as churn, (count(*) filter (b is null) + count(*) filter (c is null)) / count(*) > 0.2 as review from (select o_orderkey as c from orders where o_orderstatus <> 'F') full join (select o_orderkey as b from orders where o_orderstatus <> 'P') on b = c")
def id_churn(spark, d) -> DataFrame:
    o = read(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    return evaluate.churn(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'P'")).withColumn("churn", F.round("churn", 6))


_WILSON = """with g as (select event_type, count(*) filter (user_id % 4 = 0) as s, count(*) as n from events group by 1), w as (select *, s / n as p, 1 + 1.96 * 1.96 / n as wide from g),
x as (select *, (p + 1.96 * 1.96 / (2 * n)) / wide as mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / wide as half from w)"""


@query(f"{_WILSON} select event_type, round(greatest(mid - half, 0), 6) as low, round(least(mid + half, 1), 6) as high, round((s + 2 * 0.5) / (n + 2), 6) as bayes, round_even(least(greatest(greatest(mid - half, 0), 0.15), 0.98), 4) as bound_low, round_even(least(greatest(least(mid + half, 1), 0.15), 0.98), 4) as bound_high from x")
def confidence_bounds(spark, d) -> DataFrame:
    g = read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 4 == 0).alias("s"), F.count("*").alias("n"))
    low, high = C.wilson(F.col("s"), F.col("n"))
    b_low, b_high = C.bounds(F.col("s"), F.col("n") - F.col("s"))
    return g.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(C.bayes(F.col("s"), F.col("n") - F.col("s")), 6).alias("bayes"), b_low.alias("bound_low"), b_high.alias("bound_high"))


_DECAY = "(select event_type, user_id, exp(-ln(2) / 30.0 * (epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 86400000000.0) as f from events)"


@query(f"select event_type, round(sum(f), 4) as weight, round((0.5 + sum(case when user_id % 4 = 0 then f else 0 end)) / (0.5 + sum(f)), 6) as confidence from {_DECAY} group by 1")
def decayed_confidence(spark, d) -> DataFrame:
    days = C.age_days(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    w = C.weighted_confidence(read(spark, d, "events"), "event_type", days, F.col("user_id") % 4 == 0)
    return w.select("event_type", F.round("weight", 4).alias("weight"), F.round("confidence", 6).alias("confidence"))


@query("""with p as (select least(value / 500, 1.0) as p, case when user_id % 4 = 0 then 1.0 else 0.0 end as y from events), b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as c, avg(y) as a from p group by 1)
select round((select avg(power(p - y, 2)) from p), 6) as brier, round(sum(n * abs(c - a)) / sum(n), 6) as ece from b""")
def calibration(spark, d) -> DataFrame:
    p = read(spark, d, "events").select(F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), F.when(F.col("user_id") % 4 == 0, 1.0).otherwise(0.0).alias("y"))
    return p.agg(F.round(C.brier(F.col("p"), F.col("y")), 6).alias("brier")).crossJoin(F.broadcast(C.calibration_error(p, "p", "y").select(F.round("ece", 6).alias("ece"))))


@query("select event_type, count(*) as requests, cast(sum(user_id) as bigint) as input_tokens, cast(sum(user_id % 7) as bigint) as output_tokens, round(sum(user_id) * 3.0 / 1e6 + sum(user_id % 7) * 15.0 / 1e6, 6) as cost from events group by 1")
def usage_totals(spark, d) -> DataFrame:
    log = read(spark, d, "events").select("event_type", F.col("user_id").alias("input_tokens"), (F.col("user_id") % 7).alias("output_tokens"))
    return costs.usage_totals(log, ["event_type"], 3.0, 15.0).withColumn("cost", F.round("cost", 6))


@query("""with x as (select user_id, value, row_number() over (partition by user_id order by event_id desc) as r from events) select user_id, count(*) as n, case when min(value) >= 20 then 'CEILING' when max(value) <= 60 then 'FLOOR' when min(value) = max(value) then 'ZERO_VARIANCE' end as anomaly
from x where r <= 3 group by 1 having case when min(value) >= 20 then 'CEILING' when max(value) <= 60 then 'FLOOR' when min(value) = max(value) then 'ZERO_VARIANCE' end is not null and count(*) >= 3""")
def score_anomalies(spark, d) -> DataFrame:
    return scores.anomalies(read(spark, d, "events"), "user_id", "event_id", "value", n=3, ceiling=20, floor=60)


@query("""with x as (select user_id, value, row_number() over (partition by user_id order by event_id desc) as r from events), s as (select user_id, min(value) as lo, max(value) as hi from x where r <= 5 group by 1 having count(*) = 5),
t as (select *, cast(user_id % 4 as int) as pos, ['exploratory', 'standard', 'important', 'core'] as o from s) select user_id, o[pos + 1] as tier, o[pos + 1 + case when hi < 80 and pos < 3 then 1 else -1 end] as new_tier, case when hi < 80 and pos < 3 then 'auto' else 'manual' end as how from t where (hi < 80 and pos < 3) or (lo > 20 and pos > 0)""")
def tier_moves(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    tiers = e.select("user_id").distinct().withColumn("tier", F.element_at(F.array(*map(F.lit, scores.TIER_ORDER)), (F.col("user_id") % 4 + 1).cast("int")))
    return scores.tier_moves(e, tiers, "user_id", "event_id", "value", low=80, high=20)


@query("""select event_type, event_id, value from (select *, row_number() over (partition by event_type order by event_id desc) as r from events where ts >= timestamp '2024-01-15') where r <= 10""")
def metric_trend(spark, d) -> DataFrame:
    e = read(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return scores.trend(e, "event_type", "event_id", "value", F.lit(0), 10)


@query("""select user_id, min(ts) filter (event_type = 'signup') < min(ts) filter (event_type = 'purchase') as in_order from events group by 1""")
def order_compliance(spark, d) -> DataFrame:
    return scores.before(read(spark, d, "events"), "user_id", "ts", "event_type", "signup", "purchase")


@query("""with x as (select event_type, value, row_number() over (partition by event_type order by event_id desc) as r, count(*) over (partition by event_type) as n from events)
select event_type, round(sum(value * case when r = n then pow(0.7, r - 1) else 0.3 * pow(0.7, r - 1) end), 6) as ema from x group by 1""")
def moving_average(spark, d) -> DataFrame:
    return scores.ema(read(spark, d, "events"), "event_type", "event_id", "value").withColumn("ema", F.round("ema", 6))


@query("select coalesce(r.k, l.k) as k, coalesce(r.v, l.v) as v from (select c_custkey as k, c_acctbal as v from customer where c_nationkey < 15) l full join (select c_custkey as k, -c_acctbal as v from customer where c_nationkey >= 10) r on l.k = r.k")
def overlay_merge(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), "c_nationkey")
    return overlay.merge(c.where("c_nationkey < 15").select("k", "v"), c.where("c_nationkey >= 10").select("k", (-F.col("v")).alias("v")), ["k"])


@query("""select source, count(*) as items, cast(sum(strlen(text)) as bigint) as bytes, sha256(string_agg(text, chr(10) || chr(10) order by lang, doc_id)) as pack from (select * from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)) group by 1""")
def context_packs(spark, d) -> DataFrame:
    """Items of an id set in order, with count, bytes and the digest of their text."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("doc_id").alias("name"), F.col("text").alias("content"), "source")
    ids = read(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return overlay.context_pack(docs, ids, "source").drop("part").withColumn("pack", F.sha2("pack", 256))


@query("""select conv_id, case when bool_or(role = 'assistant' and not regexp_matches(text, '^A')) then 'success' when bool_or(role = 'assistant') then 'failed' else 'not_attempted' end as state,
case when bool_or(role = 'assistant' and not regexp_matches(text, '^A')) then 'info' when bool_or(role = 'assistant') then 'critical' else 'warning' end as severity from conversations group by 1""")
def attempt_states(spark, d) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.lit(True).alias("available"), (F.col("role") == "assistant").alias("is_query"), F.col("text").rlike("^A").alias("is_error"))
    return overlay.attempts(c, "conv_id")


@query("select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 49")
def set_difference(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(read(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey").distinct())


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersection(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer where c_acctbal > 9900 union select s_nationkey from supplier where s_acctbal > 9000")
def set_union(spark, d) -> DataFrame:
    return read(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").where("s_acctbal > 9000").select("s_nationkey")).distinct()


@query("select event_id, user_id, round(value, 2) as value from events order by ts desc limit 1")
def latest_snapshot(spark, d) -> DataFrame:
    return read(spark, d, "events").orderBy(F.col("ts").desc()).limit(1).select("event_id", "user_id", F.round("value", 2).alias("value"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def latest_per_key(spark, d) -> DataFrame:
    return overlay.latest_by_window(read(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")
