"""Scalar functions, sources and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.catalog import query
from loomgraph.functions import costs, encode, names
from loomgraph.functions.confidence import precision_level
from loomgraph.model import read
from loomgraph.operators import evaluate
from loomgraph.plans.plan import close_matches
from loomgraph.sources import files



def _values(table: dict) -> str:
    """Rows of a VALUES list from a dict of fixed values."""
    word = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join([word(k), *map(word, v if isinstance(v, tuple) else (v,))]) + ")" for k, v in table.items())


_TAGS = ", ".join(f"('{tag}', '{w}')" for tag, words in names.NAME_TAGS.items() for w in words)
_MODIFIERS = " union all ".join("select k, '" + tag + "' as tag from m where " + " or ".join("exists (select 1 from unnest(ms) u(x) where " + " and ".join(f"contains(lower(x), '{p}')" for p in parts) + ")" for parts in options) for tag, options in names.MODIFIER_TAGS.items())
_MODIFIER_WORDS = ("onlyOwner", "onlyRole", "guardianOnly", "whenNotPaused", "nonReentrant", "onlyAdmin", "allowListed")
_NAMES = ("owner", "totalSupply", "vaultReserve", "plain", "priceFeed", "stakingPool", "rewardBps")
_MODELS = ("deepseek/deepseek-v3.2", "google/gemini-3-pro-preview", "other", "minimax/minimax-m2:free", "google/gemini-3-flash-preview")
_CACHED_MODELS = ("gpt-4o", "none", "o3", "gpt-4.1")
_ROLES = ("attacker", "classifier", "nobody", "verifier", "defender")


def _pick(words: tuple[str, ...], k) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))


def _picked(words: tuple[str, ...], k: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][cast({k} % {len(words)} as int) + 1]"


_TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace(x, '[-. ]', '_', 'g'), '([A-Z])', '_\\1', 'g')), '_'), lambda t: t <> '')"


@query(f"select x, array_to_string(list_sort(list_distinct({_TOKENS})), ',') as tokens from (select distinct p_type || 'Of' || p_name || '.feeBps' as x from part)")
def identifier_tokens(spark, d) -> DataFrame:
    x = read(spark, d, "part").select(F.concat("p_type", F.lit("Of"), "p_name", F.lit(".feeBps")).alias("x")).distinct()
    return x.select("x", F.array_join(F.array_sort(names.tokens(F.col("x"))), ",").alias("tokens"))


@query(f"""with n as (select distinct {_picked(_NAMES, 'p_size')} || p_type || '_' || {_picked(_NAMES, 'p_partkey')} as x from part), t as (select x, unnest({_TOKENS}) as w from n)
select x, coalesce((select string_agg(distinct tag, ',' order by tag) from t join (values {_TAGS}) g(tag, word) on word = w where t.x = n.x), '') as tags from n""")
def variable_tags(spark, d) -> DataFrame:
    x = read(spark, d, "part").select(F.concat(_pick(_NAMES, F.col("p_size")), "p_type", F.lit("_"), _pick(_NAMES, F.col("p_partkey"))).alias("x")).distinct()
    return x.select("x", F.array_join(names.name_tags(F.col("x")), ",").alias("tags"))


@query(f"""with m as (select o_orderkey as k, [{_picked(_MODIFIER_WORDS, 'o_orderkey')}, {_picked(_MODIFIER_WORDS, 'o_custkey')}] as ms from orders), t as ({_MODIFIERS}),
g as (select m.k, coalesce(string_agg(distinct tag, ',' order by tag), '') as tags, coalesce(bool_or(tag in ({', '.join(repr(x) for x in names.PRIVILEGED)})), false) as privileged from m left join t on t.k = m.k group by m.k) select tags, privileged, count(*) as n from g group by 1, 2""")
def modifier_tags(spark, d) -> DataFrame:
    m = read(spark, d, "orders").select(names.modifier_tags(F.array(_pick(_MODIFIER_WORDS, F.col("o_orderkey")), _pick(_MODIFIER_WORDS, F.col("o_custkey")))).alias("t"))
    return m.groupBy(F.array_join("t", ",").alias("tags"), names.privileged(F.col("t")).alias("privileged")).agg(F.count("*").alias("n"))


@query("""select source, substr(sha256(string_agg(cast(doc_id as varchar), chr(10) order by cast(doc_id as varchar))), 1, 12) as graph_id from documents group by 1""")
def graph_ids(spark, d) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(names.graph_id(F.collect_list(F.col("doc_id").cast("string"))).alias("graph_id"))


@query("""select page_id, 'semgrep:' || substr(sha1('r-1:' || url || ':' || page_id || ':None'), 1, 12) as finding_id, 'bd-' || substr(sha256(url || ':' || '2024'), 1, 8) as item_id, 'CTX-' || substr(sha256('k:' || url || ':2024'), 1, 12) as context_id, url || ':' || page_id as run_id from pages""")
def hashed_ids(spark, d) -> DataFrame:
    url, k = F.col("url"), F.col("page_id")
    return read(spark, d, "pages").select(
        "page_id",
        names.finding_id("semgrep", F.lit("r-1"), url, k, F.lit(None)).alias("finding_id"),
        names.work_item_id(url, F.lit("2024")).alias("item_id"),
        names.context_item_id(F.lit("k"), url, F.lit("2024")).alias("context_id"),
        names.run_id(url, k.cast("string")).alias("run_id"),
    )


@query(f"""with u as (select {_picked(_MODELS, 'user_id')} as model, event_id % 5000 as i, user_id as o from events), p as (select * from (values {_values(costs.PRICES)}) t(m, pi, po)), l as (select * from (values {_values(costs.CONTEXT_LIMITS)}) t(m, n))
select model, count(*) as calls, round(sum(i * coalesce(pi, {costs.DEFAULT_PRICE[0]}) / 1e6 + o * coalesce(po, {costs.DEFAULT_PRICE[1]}) / 1e6), 6) as cost, any_value(coalesce(l.n, {costs.DEFAULT_CONTEXT})) as "limit", coalesce(any_value(pi + po), 1) = 0 as free,
case when contains(model, 'gemini') then 'google' else 'unknown' end as vendor from u left join p on p.m = model left join l on l.m = model group by model""")
def model_costs(spark, d) -> DataFrame:
    c = F.col("model")
    u = read(spark, d, "events").select(_pick(_MODELS, F.col("user_id")).alias("model"), (F.col("event_id") % 5000).alias("i"), F.col("user_id").alias("o"))
    g = u.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum(costs.cost(c, F.col("i"), F.col("o"))), 6).alias("cost"))
    return g.select("model", "calls", "cost", costs.context_limit(c).alias("limit"), costs.is_free(c).alias("free"), costs.vendor(c).alias("vendor"))


@query(f"""with u as (select {_picked(_CACHED_MODELS, 'o_custkey')} as model, o_orderkey % 3000 + 400 as i, o_custkey as o, o_orderkey % 400 as r, 44 as w from orders), p as (select * from (values {_values(costs.CACHED_PRICES)}) t(m, pi, po, pr, pw))
select model, round(sum(case when m is null then (i * {costs.FLAT_PRICE[0]} + o * {costs.FLAT_PRICE[1]}) / 1e6 else (i - r) * pi / 1e6 + o * po / 1e6 + r * pr / 1e6 + w * pw / 1e6 end), 6) as cost from u left join p on m = model group by model""")
def cached_costs(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    u = read(spark, d, "orders").select(_pick(_CACHED_MODELS, c).alias("model"), (k % 3000 + 400).alias("i"), c.alias("o"), (k % 400).alias("r"))
    return u.groupBy("model").agg(F.round(F.sum(costs.cost_with_cache(F.col("model"), F.col("i"), F.col("o"), F.col("r"), F.lit(44))), 6).alias("cost"))


@query(f"""select role, coalesce(b, {costs.DEFAULT_BUDGET}) as budget, count(*) as calls, count(*) filter (value * 50 > coalesce(b, {costs.DEFAULT_BUDGET})) as over from (select {_picked(_ROLES, 'user_id')} as role, value from events) left join (values {_values(costs.ROLE_BUDGETS)}) t(r, b) on r = role group by 1, 2""")
def role_budgets(spark, d) -> DataFrame:
    e = read(spark, d, "events").select(_pick(_ROLES, F.col("user_id")).alias("role"), "value")
    return e.withColumn("budget", costs.role_budget(F.col("role"))).groupBy("role", "budget").agg(F.count("*").alias("calls"), F.count_if(F.col("value") * 50 > F.col("budget")).alias("over"))


@query("""select c_mktsegment as segment, '{"sev":"' || case when c_mktsegment = 'BUILDING' then 'HIGH' else c_mktsegment end || '","ln":' || c_nationkey || '}' as j, count(*) as n from customer group by 1, 2""")
def compact_encoding(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_mktsegment") == "BUILDING", "high").otherwise(F.col("c_mktsegment")).alias("severity"), F.col("c_nationkey").alias("line_number"))
    return c.select("segment", encode.compact_json(c, ["severity", "line_number"]).alias("j")).groupBy("segment", "j").agg(F.count("*").alias("n"))


@query(f"""with v as (select lower(split_part(o_orderpriority, '-', 2)) as v from orders union all select case when p_size % 2 = 0 then 'external_call' else lower(p_type) end from part)
select v, coalesce(short, v) as short, v as back, count(*) as n from v left join (values {_values(encode.VALUES)}) t(long, short) on long = v group by 1, 2""")
def value_abbreviations(spark, d) -> DataFrame:
    """Of the two values with the short form xcall, the table has one."""
    v = read(spark, d, "orders").select(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("v"))
    v = v.unionAll(read(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "external_call").otherwise(F.lower("p_type"))))
    return v.groupBy("v").agg(F.count("*").alias("n")).select("v", encode.short_value(F.col("v")).alias("short"), encode.long_value(encode.short_value(F.col("v"))).alias("back"), "n")


@query("""with t as (select doc_id, length(text) as n, 'fn:' || doc_id || '|vis:' || lang as t1, '|sig:' || source as t2, '|lines:[' || substr(text, 1, 50) || ']' as t4, '|source:' || case when length(text) > 3000 then substr(text, 1, 3000) || '...[truncated]' else text end as t5, (doc_id % 4) * 400 as budget from documents),
b as (select *, case when budget >= 75 and length(t1) // 4 < budget then t1 || t2 else t1 end as x2 from t), c as (select *, case when budget >= 300 and length(x2) // 4 < budget then x2 || t4 else x2 end as x4 from b),
e as (select *, case when budget >= 1000 and length(x4) // 4 < budget then x4 || t5 else x4 end as x5 from c) select doc_id, sha256(x5) as digest, cast(length(x5) // 4 as int) as tokens, round(n / greatest(length(x5) // 4, 1), 6) as ratio from e""")
def tiered_context(spark, d) -> DataFrame:
    t = read(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    tiers = [
        F.concat(F.lit("fn:"), F.col("doc_id").cast("string"), F.lit("|vis:"), "lang"),
        F.concat(F.lit("|sig:"), "source"),
        F.lit(""),
        F.concat(F.lit("|lines:["), F.substring(text, 1, 50), F.lit("]")),
        F.concat(F.lit("|source:"), encode.cut(text, 3000)),
    ]
    t = t.withColumn("x", encode.with_tiers(tiers, (F.col("doc_id") % 4) * 400)[1])
    return t.select("doc_id", F.sha2("x", 256).alias("digest"), encode.estimate_tokens(F.col("x")).alias("tokens"), F.round(encode.compression_ratio(F.length(text), encode.estimate_tokens(F.col("x"))), 6).alias("ratio"))


@query("""select l_orderkey, array_to_string(list_slice(p, 1, 5), ',') as first5, len(p) as n from (select l_orderkey, list(cast(l_partkey as varchar) order by l_partkey) as p from lineitem group by 1)""")
def truncated_lists(spark, d) -> DataFrame:
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    return o.select("l_orderkey", encode.joined(F.transform("p", lambda x: x.cast("string")), 5).alias("first5"), F.size("p").cast("bigint").alias("n"))


@query("select doc_id, strlen(text) as bytes, round_even((1 - length(replace(text, ' ', '')) / length(text)) * 100, 1) as reduction from documents")
def text_sizes(spark, d) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.octet_length(t).cast("bigint").alias("bytes"), encode.reduction(t, F.replace(t, F.lit(" "), F.lit(""))).alias("reduction"))


@query("""select page_id, nullif(regexp_extract(html, '<html lang="(\\w+)">', 1), '') as lang, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') as links from pages""")
def regex_extraction(spark, d) -> DataFrame:
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(h, r'<html lang="(\w+)">', 1), F.lit("")).alias("lang"), F.array_join(names.all_matches(h, '<a href="([^"]*)"'), " ").alias("links"))


@query("""with x as (select page_id, case page_id % 4 when 0 then 'contract C {}' else 'pragma solidity ' || ['^', '>=', ''][page_id % 3 + 1] || '0.' || page_id % 9 || case when page_id % 4 = 1 then '' else '.' || page_id % 20 end || ';' end as t from pages)
select page_id, case when page_id % 4 = 0 then null else '0.' || page_id % 9 || '.' || case when page_id % 4 = 1 then '0' else cast(page_id % 20 as varchar) end end as version from x""")
def pragma_versions(spark, d) -> DataFrame:
    k = F.col("page_id")
    text = F.concat(F.lit("pragma solidity "), _pick(("^", ">=", ""), k), F.lit("0."), (k % 9).cast("string"), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("."), (k % 20).cast("string"))), F.lit(";"))
    x = read(spark, d, "pages").select("page_id", F.when(k % 4 == 0, "contract C {}").otherwise(text).alias("t"))
    return x.select("page_id", names.pragma_version(F.col("t")).alias("version"))


@query("select conv_id, turn, sha256(substr(coalesce(nullif(case when role = 'user' then '' else text end, ''), text), 1, 400)) as digest from conversations")
def first_nonempty_text(spark, d) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(encode.first_text(F.when(F.col("role") == "user", "").otherwise(t), t, most=400), 256).alias("digest"))


@query("""select event_type, cast(json_extract(props, '$.k') as int) as k, count(*) as n from events where json_extract(props, '$.k') is not null group by 1, 2""")
def json_decode(spark, d) -> DataFrame:
    e = read(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.where("k is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("select tool, severity, count(*) as n from (select p_brand as tool, case when p_size % 4 = 0 then 'CRITICAL' when p_size % 4 = 1 then 'HIGH' when p_size % 4 = 2 then 'MEDIUM' else 'INFO' end as severity from part) group by 1, 2")
def tool_severities(spark, d) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("critical", "error", "warning", "note"))), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("tool"), files.severity_of(level).alias("severity")).agg(F.count("*").alias("n"))


@query("select p_brand, case when avg(p_size) / 30 >= 0.9 then 'HIGH' when avg(p_size) / 30 >= 0.75 then 'MEDIUM' else 'LOW' end as level from part group by 1")
def precision_levels(spark, d) -> DataFrame:
    return read(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") / 30).alias("p")).select("p_brand", precision_level(F.col("p")).alias("level"))


@query("""select id, check_id, has_place from (select 'semgrep:' || substr(sha1('c-' || (page_id % 5) || ':' || url || ':' || page_id || ':' || (page_id + 2)), 1, 12) as id, 'c-' || (page_id % 5) as check_id, true as has_place from pages)""")
def findings_to_graph(spark, d) -> DataFrame:
    f = read(spark, d, "pages").select(F.concat(F.lit("c-"), (F.col("page_id") % 5).cast("string")).alias("check_id"), F.col("url").alias("path"), F.col("page_id").cast("int").alias("line_start"), (F.col("page_id") + 2).cast("int").alias("line_end"), F.lit("HIGH").alias("severity"), F.lit("m").alias("message"))
    return files.findings_graph(f).select("id", F.col("label").alias("check_id"), (F.size("evidence") > 0).alias("has_place"))


@query("""select 's' || (user_id % 5) || ':' || event_id as run_id, value as duration_ms, concat_ws(',', case when event_type = 'view' then 'q' || event_id end, case when user_id % 3 = 0 then 'one' || user_id end) as queries,
case when user_id % 4 = 0 then 't' when event_id % 3 = 0 then 'a,b' when event_type = 'view' then 'Bash' else '' end as tools,
case when event_id % 7 = 0 then 'raw' when event_id % 7 = 1 then 'top' when event_id % 7 = 2 then 'text' when event_id % 7 = 3 then 'out' when event_id % 7 = 4 then 'res' else '' end as response from events where event_type <> 'error'""")
def hook_inputs(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    k, word = F.col("event_id"), lambda n, x: F.when(F.col("event_id") % 7 == n, x)
    use = F.when(F.col("event_type") != "error", k.cast("string")).otherwise(F.lit(""))
    q = F.when(F.col("event_type") == "view", F.array(F.struct(F.concat(F.lit("q"), k.cast("string")).alias("query_text"))))
    data = F.struct(
        F.when(F.col("user_id") % 4 == 0, "t").otherwise("").alias("tool_name"),
        F.when((F.col("user_id") % 4 != 0) & (k % 3 == 0), F.array(F.lit("a"), F.lit("b"))).alias("tool_sequence"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("one"), F.col("user_id").cast("string"))).alias("query"),
        F.col("value").alias("duration_ms"), word(0, "raw").alias("raw_observation"), word(2, "text").alias("response_text"), word(3, "out").alias("output"), q.alias("graph_queries"),
    )
    kind = F.when(F.col("event_type") == "view", "graph_query").otherwise("tool_use")
    p = e.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("session_id"), use.alias("tool_use_id"), kind.alias("event_type"), word(1, "top").alias("raw_observation"), word(4, "res").alias("result"), data.alias("data"))
    got = files.evaluation_inputs(p)
    return got.select("run_id", "duration_ms", F.array_join("queries", ",").alias("queries"), F.array_join("tools", ",").alias("tools"), "response")


@query("select c_custkey, round((cast(c_acctbal > 0 as int) + cast(c_nationkey > 5 as int) + cast(c_mktsegment = 'BUILDING' as int)) / 3.0, 6) as share, concat_ws(',', case when c_acctbal <= 0 then 'balance' end, case when c_nationkey <= 5 then 'nation' end, case when c_mktsegment <> 'BUILDING' then 'segment' end) as missing from customer")
def completeness(spark, d) -> DataFrame:
    share, missing = evaluate.completeness({"balance": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") > 5, "segment": F.col("c_mktsegment") == "BUILDING"})
    return read(spark, d, "customer").select("c_custkey", F.round(share, 6).alias("share"), F.array_join(missing, ",").alias("missing"))


@query("select doc_id, contains(lower(text), 'license') or contains(lower(text), 'token') as found from documents")
def keyword_check(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", encode.any_keyword(F.col("text"), ["license", "token"]).alias("found"))


@query("select distinct left(c_mktsegment, length(c_mktsegment) - 1) as name, c_mktsegment as matches from customer")
def name_suggestions(spark, d) -> DataFrame:
    """The segments as the names that are known, and each without its last letter as what was asked."""
    known = sorted(r[0] for r in read(spark, d, "customer").select("c_mktsegment").distinct().collect())
    return spark.createDataFrame([(n[:-1], ",".join(close_matches(n[:-1], known))) for n in known], "name string, matches string")


@query("select count(*) filter (ts >= timestamp '2024-01-21') as kept, count(*) filter (ts < timestamp '2024-01-21') as dropped from events")
def retention(spark, d) -> DataFrame:
    pts = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept, dropped = files.retain(pts, F.lit("2024-01-31").cast("timestamp"), 10)
    return kept.agg(F.count("*").alias("kept")).crossJoin(F.broadcast(dropped.agg(F.count("*").alias("dropped"))))
