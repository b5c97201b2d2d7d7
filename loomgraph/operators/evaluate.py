"""Benchmarks, ground truth, regressions, coverage and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.metrics import ratio
from loomgraph.scratch import table, work


def challenge_rates(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, detected, detection_rate (skipped ones out of the total, errors in),
    avg_recall and false_positives."""
    live = F.col("status") != "skipped"
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("actual") / F.col("expected"))
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "detected").alias("detected"),
        ratio(F.count_if(F.col("status") == "detected"), F.count_if(live)).alias("detection_rate"),
        F.coalesce(F.avg(F.when(live, recall)), F.lit(0.0)).alias("avg_recall"),
        F.coalesce(F.sum(F.size("false_positives")), F.lit(0)).alias("false_positives"),
    )


def declared_rate(suite: DataFrame) -> DataFrame:
    """detectable (not counting not-applicable), detected and their ratio, by declared status."""
    able, found = F.count_if(F.col("status") != "not-applicable"), F.count_if(F.col("status") == "detected")
    return suite.agg(able.alias("detectable"), found.alias("detected"), ratio(found, able).alias("rate"))


def compare_runs(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """change of each current challenge: a new one that is detected, or undetected, counts
    as improved; those only in the baseline are left out."""
    b = baseline.select(F.col("challenge_id").alias("__c"), F.col("status").alias("before"))
    now, then = F.col("status") == "detected", F.col("before") == "detected"
    change = F.when(F.col("before").isNull(), "improved").when(now & ~then, "improved").when(~now & then, "regressed").otherwise("unchanged")
    return current.join(b, F.col("challenge_id") == F.col("__c"), "left").select("challenge_id", "status", "before", change.alias("change"))


def regression(current: DataFrame, baseline: DataFrame, key: str, value: str, threshold: float = 0.05) -> DataFrame:
    """Full outer: a missing value is 0; passed if the current one lost no more than threshold."""
    c, b = current.select(key, F.col(value).alias("current")), baseline.select(key, F.col(value).alias("baseline"))
    out = c.join(b, key, "full").select(key, F.coalesce("current", F.lit(0.0)).alias("current"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"))
    return out.withColumn("delta", F.col("current") - F.col("baseline")).withColumn("passed", F.col("delta") >= -threshold)


def micro_scores(projects: DataFrame) -> DataFrame:
    """precision, recall and f1 over summed tp, fp, fn; 0 where undefined, 4 digits."""
    s = projects.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    s = s.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.select("tp", "fp", "fn", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), F.bround(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 4).alias("f1"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Counts, and time and memory figures of the runs that succeeded."""
    ok = F.col("success")
    only = lambda c: F.when(ok, F.col(c))
    return runs.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        *(f(only(c)).alias(f"{n}_{c}") for c in ("seconds", "memory") for n, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))),
    )


def coverage(expected: DataFrame, evaluated: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """share of expected keys that were evaluated (3 digits), and the missing ones in order."""
    seen = evaluated.select(F.col(key).alias("__k")).distinct()
    rows = expected.select(*([by] if by else []), key).distinct().join(seen, F.col(key) == F.col("__k"), "left")
    return rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("expected"),
        F.count("__k").alias("covered"),
        F.bround(ratio(F.count("__k"), F.count("*")), 3).alias("share"),
        F.array_sort(F.collect_list(F.when(F.col("__k").isNull(), F.col(key)))).alias("missing"),
    )


def coverage_axes(results: DataFrame, axes: dict[str, list[str]], least: float = 0.5) -> DataFrame:
    """(axis, value, n, share, gap) over several axes in one pass: what part of the
    results each expected value of an axis covers by passing, 3 digits; a value
    without results has 0, and a gap is a share below least. axes: column to its
    expected values."""
    spark = results.sparkSession
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes)))
    counted = results.select("passed", each.alias("x")).groupBy("x.axis", "x.value").agg(F.count("*").alias("n"), F.bround(ratio(F.count_if("passed"), F.count("*")), 3).alias("share"))
    wanted = spark.createDataFrame([(a, v) for a, vs in axes.items() for v in vs], "axis string, value string")  # one row an expected value
    out = wanted.join(counted, ["axis", "value"], "left").select("axis", "value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))
    return out.withColumn("gap", F.col("share") < least)


def stability_gates(runs: DataFrame, by: str, most_cv: float = 0.15, most_findings: int = 2, most_tokens: float = 0.25, most_seconds: float = 0.30) -> DataFrame:
    """Runs of one configuration (findings, tokens, seconds) against four gates: spread of
    the findings (population deviation over mean), their largest difference, and the
    largest relative differences of tokens and seconds, over their least."""
    cv = F.coalesce(F.stddev_pop("findings") / F.nullif(F.avg("findings"), F.lit(0.0)), F.lit(0.0))
    delta = lambda c: (F.max(c) - F.min(c)) / F.nullif(F.min(c), F.lit(0))
    g = runs.groupBy(by).agg(cv.alias("findings_cv"), (F.max("findings") - F.min("findings")).alias("findings_delta"), delta("tokens").alias("tokens_delta"), delta("seconds").alias("seconds_delta"))
    holds = (F.col("findings_cv") <= most_cv) & (F.col("findings_delta") <= most_findings) & (F.col("tokens_delta") <= most_tokens) & (F.col("seconds_delta") <= most_seconds)
    return g.withColumn("passed", F.coalesce(holds, F.lit(False)))


def group_profile(members: DataFrame, by: str, counts: dict[str, Column], flags: dict[str, Column], bands: tuple[tuple[int, str], ...] = ((20, "small"), (50, "medium"), (100, "large")), largest: str = "very_large") -> DataFrame:
    """A row for each group: members, a count for each condition of counts, whether any
    member has each flag (a missing one is no), and the band of its size."""
    n = F.count("*")
    band = F.lit(largest)
    for below, name in reversed(bands):
        band = F.when(n < below, name).otherwise(band)
    return members.groupBy(by).agg(n.alias("members"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in flags.items()), band.alias("size_band"))


def variance_gate(runs: DataFrame, by: str, value: str, most: float = 0.15) -> DataFrame:
    """Coefficient of variation (population) and whether it stays within most."""
    cv = F.stddev_pop(value) / F.avg(value)
    return runs.groupBy(by).agg(F.count("*").alias("n"), cv.alias("cv"), (F.max(value) - F.min(value)).alias("spread"), F.coalesce(cv <= most, F.lit(False)).alias("passed"))


def agreement(marks: DataFrame, item: str, judge: str, judges: int) -> DataFrame:
    """One row: items that all judges have, of those that any has (Jaccard)."""
    each = marks.groupBy(item).agg(F.count_distinct(judge).alias("n"))
    return each.agg(F.count_if(F.col("n") == judges).alias("common"), F.count("*").alias("any"), ratio(F.count_if(F.col("n") == judges), F.count("*")).alias("jaccard"))


def gauntlet(cases: DataFrame, by: list[str] | None = None, least: int = 0, most_fp: int = 0, most_fn: int = 0) -> DataFrame:
    """tp + tn - 2 fp - 2 fn, whether it passes, and whether a perfect score asks for a second look."""
    n = lambda a, b: F.count_if((F.col("vulnerable") == a) & (F.col("flagged") == b))
    tp, tn, fp, fn = n(True, True), n(False, False), n(False, True), n(True, False)
    score = tp + tn - 2 * fp - 2 * fn
    return cases.groupBy(*(by or [])).agg(tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), score.alias("score"), ((score >= least) & (fp <= most_fp) & (fn <= most_fn)).alias("passed"), ((fp == 0) & (fn == 0)).alias("suspicious"))


def slo_windows(events: DataFrame, ts: str, value: str, width: str = "5 minutes", target: float = 300.0, alert: float = 360.0, share: float = 0.95) -> DataFrame:
    """p95 of each tumbling window against its target and alert level."""
    p = F.percentile(value, share)
    w = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), p.alias("p95"))
    return w.select(F.col("w.start").alias("window_start"), "n", "p95", F.when(F.col("p95") > alert, "alert").when(F.col("p95") > target, "missed").otherwise("met").alias("slo"))


def usage(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("query_count"), F.count_distinct("node_id").alias("unique_nodes"), F.sum("seconds").alias("seconds"))


def truth_coverage(truth: DataFrame, dims: list[str]) -> DataFrame:
    """Findings and share that should be found, by each dimension and in all, in one pass."""
    out = truth.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count("*").alias("total"), F.count_if("detectable").alias("detectable"), ratio(F.count_if("detectable"), F.count("*")).alias("share"))
    return out


def truth_gate(truth: DataFrame, category: str, source: str, least_findings: int, least_sources: int) -> DataFrame:
    n, s = F.count("*"), F.count_distinct(source)
    return truth.groupBy(category).agg(n.alias("findings"), s.alias("sources"), ((n >= least_findings) & (s >= least_sources)).alias("passed"))


def build_gate(current: DataFrame, baseline: DataFrame, kind: str = "type", spread: float = 0.3) -> DataFrame:
    """Row counts by kind against a baseline, within +- spread of it."""
    c, b = current.groupBy(kind).agg(F.count("*").alias("n")), baseline.groupBy(kind).agg(F.count("*").alias("n0"))
    out = c.join(b, kind, "full").select(kind, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n0", F.lit(0)).alias("n0"))
    return out.withColumn("passed", F.abs(F.col("n") - F.col("n0")) <= F.col("n0") * spread)


def churn(current: DataFrame, baseline: DataFrame, most: float = 0.2) -> DataFrame:
    """One row: ids added and removed, their share of all ids, and whether to review."""
    c, b = current.select("id", F.lit(1).alias("c")), baseline.select("id", F.lit(1).alias("b"))
    out = c.join(b, "id", "full").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("c").isNull()).alias("removed"), F.count("*").alias("ids"))
    return out.withColumn("churn", ratio(F.col("added") + F.col("removed"), F.col("ids"))).withColumn("review", F.col("churn") > most)


def match_truth(findings: DataFrame, truth: DataFrame, on: list[str], line: str, tolerance: int = 10) -> DataFrame:
    """Pairs of a finding and a truth row on the same place, one to one: the nearest
    pairs first (ties by finding, then truth), until no two rows within tolerance are
    free. Each round takes all pairs that are the first of both their sides, which
    gives what going through all pairs in order would. Both sides meet only within
    bands of (tolerance + 1) lines, so a place with many rows does not pair them all."""
    band = tolerance + 1
    t = truth.select(F.col("id").alias("truth_id"), *(F.col(c).alias(f"__{c}") for c in on), F.col(line).alias("__line"), F.explode(F.array(*(F.floor(F.col(line) / band) + k for k in (-1, 0, 1)))).alias("__band"))
    f = findings.select(F.col("id").alias("finding_id"), *on, line, F.floor(F.col(line) / band).alias("__own"))
    pairs = f.join(t, [*(F.col(c) == F.col(f"__{c}") for c in on), F.col("__own") == F.col("__band")]).withColumn("distance", F.abs(F.col(line) - F.col("__line"))).where(F.col("distance") <= tolerance)
    place = F.struct("distance", "finding_id", "truth_id")
    with work() as made:
        free = table(pairs.select("finding_id", "truth_id", "distance"), "free", made)
        out: DataFrame | None = None
        while True:
            # the first pair of each finding that is also the first of its truth row
            own = free.groupBy("finding_id").agg(F.min(place).alias("p")).select("p.*")
            other = free.groupBy(F.col("truth_id").alias("__t")).agg(F.min(place).alias("p")).select("__t", F.col("p.finding_id").alias("__f"))
            taken = table(own.join(other, (F.col("truth_id") == F.col("__t")) & (F.col("finding_id") == F.col("__f"))).select("finding_id", "truth_id", "distance"), "taken")
            out = taken if out is None else out.unionByName(taken)
            left = free.join(taken.select("finding_id"), "finding_id", "left_anti").join(taken.select("truth_id"), "truth_id", "left_anti")
            free = table(left.select("finding_id", "truth_id", "distance"), "free", made)
            if free.isEmpty():
                return out


def completeness(checks: dict[str, Column]) -> tuple[Column, Column]:
    """Share of named checks that hold, and the names of the others in order."""
    missing = F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))))
    return (F.lit(len(checks)) - F.size(missing)) / F.lit(float(len(checks))), missing


# What a knowledge document must hold, and a summary of it.
DOCUMENT_FIELDS = (
    "id", "name", "category", "subcategory", "severity", "one_liner", "tldr", "detection.graph_signals", "detection.indicators", "detection.checklist", "exploitation.attack_vector", "exploitation.attack_steps",
    "exploitation.potential_impact", "mitigation.primary_fix", "mitigation.how_to_verify", "examples.vulnerable_code", "examples.fixed_code", "examples.real_exploits", "pattern_linkage", "metadata.sources",
)
SUMMARY_FIELDS = ("key_points", "attack_vector", "attack_steps", "mitigation", "safe_patterns", "vulnerable_code", "fixed_code", "incidents")
# Words one of which a checklist must hold, in two categories.
AUTH_CATEGORIES = ("access-control", "logic")
AUTH_WORDS = {
    "auth.permission_model": ("permission", "role", "access", "auth"),
    "auth.trust_boundaries": ("trust boundary", "caller", "external"),
    "logic.invariants": ("invariant", "state", "assumption"),
    "abuse_case_checklist": ("abuse", "misuse", "edge case"),
}


def document_completeness(filled: Column, category: Column, checklist: Column, fields: tuple[str, ...] = DOCUMENT_FIELDS) -> tuple[Column, Column]:
    """(share, missing names) of a document: filled is the array of the names that hold
    something; documents of AUTH_CATEGORIES have four more checks on their checklist."""
    missing = F.array_except(F.array(*map(F.lit, fields)), filled)
    words = F.array(*(F.when(~F.coalesce(F.lower(checklist).rlike("|".join(w)), F.lit(False)), F.lit(name)) for name, w in AUTH_WORDS.items()))
    strict = F.coalesce(category.isin(*AUTH_CATEGORIES), F.lit(False))
    missing = F.array_sort(F.concat(missing, F.when(strict, F.array_compact(words)).otherwise(F.array().cast("array<string>"))))
    total = F.lit(float(len(fields))) + F.when(strict, len(AUTH_WORDS)).otherwise(0)
    return (total - F.size(missing)) / total, missing


def tier_rate(actual: Column, tier: Column) -> Column:
    """Whether a test tier's pass rate reaches its minimum."""
    least = F.when(tier == "critical", 1.0).when(tier == "important", 0.25).otherwise(0.05)
    return actual >= least
