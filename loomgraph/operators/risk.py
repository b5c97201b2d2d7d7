"""Consensus, weighted risk, pay-offs, loss over paths, and cascades.

Only the names of these are given; the formulas are this package's own and stand
in each docstring. All are aggregates and joins but the cascade, which is a
bounded walk whose rounds are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.metrics import ratio
from loomgraph.scratch import table, work


def consensus(votes: DataFrame, item: str, voter: str, vote: str, weights: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(item, votes, support, verdict): the weight of the yes votes as a share of all,
    and whether it is above least. weights: (voter, weight); a voter without one has 1."""
    w = F.lit(1.0)
    if weights is not None:
        votes = votes.join(weights.select(F.col(voter).alias("__v"), F.col("weight").alias("__w")), F.col(voter) == F.col("__v"), "left")
        w = F.coalesce("__w", F.lit(1.0))
    support = ratio(F.sum(F.when(F.col(vote), w).otherwise(0.0)), F.sum(w))
    return votes.groupBy(item).agg(F.count("*").alias("votes"), support.alias("support")).withColumn("verdict", F.col("support") > least)


def reputation(votes: DataFrame, verdicts: DataFrame, item: str, voter: str, vote: str) -> DataFrame:
    """(voter, votes, weight): the share of a voter's votes that agree with the verdict, smoothed by one of each kind."""
    v = verdicts.select(F.col(item).alias("__i"), F.col("verdict").alias("__v"))
    agreed = votes.join(v, F.col(item) == F.col("__i"))
    return agreed.groupBy(voter).agg(F.count("*").alias("votes"), ((F.count_if(F.col(vote) == F.col("__v")) + 1) / (F.count("*") + 2)).alias("weight"))


def risk_score(factors: dict[str, tuple[Column, float]]) -> Column:
    """The weighted mean of factors, each cut to 0 to 1; a missing one counts 0."""
    total = sum(w for _, w in factors.values())
    out = F.lit(0.0)
    for value, weight in factors.values():
        out = out + F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (weight / total)
    return out


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "critical").when(score >= 0.5, "high").when(score >= 0.25, "medium").otherwise("low")


def payoff(gain: Column, chance: Column, cost: Column, penalty: Column) -> Column:
    """What an attacker may expect: gain by chance, less the cost and the penalty of failure."""
    return gain * chance - cost - penalty * (1 - chance)


def mixed_equilibrium(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The row player's share of the first row in a 2 x 2 zero-sum game ((a, b), (c, d)): 1
    or 0 with a saddle point, else what makes the column player indifferent."""
    low, high = F.greatest(F.least(a, b), F.least(c, d)), F.least(F.greatest(a, c), F.greatest(b, d))
    return F.when(low == high, F.when(F.least(a, b) >= F.least(c, d), 1.0).otherwise(0.0)).otherwise((d - c) / F.nullif(a - b - c + d, F.lit(0.0)))


def any_of(chance: Column) -> Column:
    """The chance that at least one of independent causes holds, as an aggregate."""
    sure = F.bool_or(chance >= 1)
    return F.when(sure, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.greatest(F.least(chance, F.lit(1 - 1e-15)), F.lit(0.0))))))


def causal_paths(first: DataFrame, second: DataFrame, without: Column | None = None) -> DataFrame:
    """(cause, effect, chance): links cause -> middle and middle -> effect with chances,
    the chances along a path multiplied and those of all paths joined; without: a
    condition on middle that is taken away (a counterfactual)."""
    rows = first.select("cause", "middle", F.col("chance").alias("__p")).join(second.select("middle", "effect", F.col("chance").alias("__q")), "middle")
    rows = rows if without is None else rows.where(~without)
    return rows.groupBy("cause", "effect").agg(any_of(F.col("__p") * F.col("__q")).alias("chance"))


def cascade(links: DataFrame, start: DataFrame, decay: float = 0.5, rounds: int = 3) -> DataFrame:
    """(id, impact): a shock at the nodes of start (id, impact) goes along links (source,
    target, share) with decay, for some rounds; what reaches a node adds up."""
    with work() as made:
        front = table(start.select("id", F.col("impact").cast("double").alias("impact")), "shock", made)
        held = [front]
        for _ in range(rounds):
            moved = links.join(front, F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("impact") * F.col("share") * decay).alias("impact"))
            front = table(moved, "shock", made)
            held.append(front)
        out = held[0]
        for h in held[1:]:
            out = out.unionByName(h)
        return table(out.groupBy("id").agg(F.sum("impact").alias("impact")), "impact")


def enriched(findings: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """findings with the columns of a taxonomy row of that key, null if there is none."""
    names = [c for c in taxonomy.columns if c != key]
    return findings.join(taxonomy.select(F.col(key).alias("__k"), *names), F.col(key) == F.col("__k"), "left").drop("__k")


def rollup(counts: DataFrame, parents: DataFrame, value: str) -> DataFrame:
    """(tag, value): each tag's own value and those of all tags below it, by a table of
    (tag, parent) without rings. A round goes up one level; its rows are one a tag."""
    with work() as made:
        up = table(parents.select(F.col("tag").alias("__c"), "parent").distinct(), "parents", made)
        front = table(counts.groupBy("tag").agg(F.sum(value).alias(value)), "tags", made)
        held = [front]
        while True:
            front = table(front.join(up, F.col("tag") == F.col("__c")).groupBy(F.col("parent").alias("tag")).agg(F.sum(value).alias(value)), "tags", made)
            if front.isEmpty():
                break
            held.append(front)
        out = held[0]
        for h in held[1:]:
            out = out.unionByName(h)
        return table(out.groupBy("tag").agg(F.sum(value).alias(value)), "rollup")


def learned_rate(findings: DataFrame, history: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """findings with rate and tier: the share of past findings (false_positive) with the
    same keys if there were at least `least`, else with the same first key, else 0."""
    share = F.avg(F.col("false_positive").cast("int"))
    place = history.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(share.alias("__near"), F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    pattern = history.groupBy(F.col(keys[0]).alias("__first")).agg(share.alias("__far"))
    out = findings.join(place, [F.col(k) == F.col(f"__{k}") for k in keys], "left").join(pattern, F.col(keys[0]) == F.col("__first"), "left")
    tier = F.when(F.col("__near").isNotNull(), "place").when(F.col("__first").isNotNull(), "pattern").otherwise("none")
    return out.select(*findings.columns, F.coalesce("__near", "__far", F.lit(0.0)).alias("rate"), tier.alias("tier"))
