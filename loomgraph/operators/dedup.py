"""Findings of several tools: clusters, merging by embedding, agreement, skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import components
from loomgraph.workers import ready

GAP = 5


def line_clusters(findings: DataFrame, by: list[str], line: str, gap: float = GAP, tie: str = "id") -> DataFrame:
    """findings with cluster: single linkage along the sorted lines of a place; a
    cluster's number is counted within the place."""
    w = Window.partitionBy(*by).orderBy(line, tie)
    start = F.coalesce(F.col(line) - F.lag(line).over(w) > gap, F.lit(True)).cast("int")
    return findings.withColumn("__start", start).withColumn("cluster", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def agreement_boost(confidence: Column, tools: Column) -> Column:
    return F.least(F.lit(1.0), confidence + F.when(tools >= 3, 0.2).when(tools == 2, 0.1).otherwise(0.0))


def merged(clusters: DataFrame, by: list[str], tool: str, confidence: str) -> DataFrame:
    """A row for each cluster: size, distinct tools and boosted best confidence."""
    out = clusters.groupBy(*by, "cluster").agg(F.count("*").alias("findings"), F.count_distinct(tool).alias("tools"), F.max(confidence).alias("best"))
    return out.withColumn("boosted", agreement_boost(F.col("best"), F.col("tools")))


def alike(vectors: DataFrame, id_: str, vector: str, block: str, least: float = 0.85, rows: int = 1024) -> DataFrame:
    """(a, b, similarity), a < b, of one block whose cosine is above least. A block's
    rows are dealt to parts of about `rows`, and each pair of parts is one matrix
    product in one task, however large the block. Blocks are the caller's bound on the
    work (a label, a place): every pair of a block is compared. Null ids and vectors,
    and vectors without a length, are alike to nothing."""
    spark = vectors.sparkSession
    ready(spark)
    own = vectors.select(F.col(id_).alias("i"), F.col(vector).cast("array<double>").alias("v"), F.col(block).alias("g")).where("i is not null and v is not null")
    sizes = own.groupBy(F.col("g").alias("h")).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    own = own.join(sizes, F.col("g").eqNullSafe(F.col("h"))).withColumn("s", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("s", o).alias("x"), F.greatest("s", o).alias("y")))
    dealt = own.select("g", "i", "v", "s", F.explode(meets).alias("m")).select("g", "m.x", "m.y", "s", "i", "v")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(own.dtypes)["i"]
    return dealt.repartition(n, "g", "x", "y").sortWithinPartitions("g", "x", "y", "s").mapInArrow(_products(least), f"a {kind}, b {kind}, similarity double")


def _products(least: float):
    """Cosines of the pairs of two parts; rows of (g, x, y) come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("i").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from _compared(held, least, kind)
                    held = []
                held.append(row)
        if held:
            yield from _compared(held, least, kind)

    return run


def _compared(held: list[tuple], least: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    _, x, y, *_ = held[0]
    sides = []
    for part in (x, y):
        rows = [r for r in held if r[3] == part]
        v = np.array([r[5] for r in rows], np.float64).reshape(len(rows), -1)
        length = np.sqrt((v * v).sum(1))
        sides.append(([r[4] for r, n in zip(rows, length, strict=True) if n > 0], v[length > 0] / length[length > 0, None]))
        if x == y:
            sides.append(sides[0])
            break
    (ids, v), (others, w) = sides
    if not ids or not others:
        return
    found = v @ w.T
    at, to = np.nonzero(found > least)
    pairs = [(min(ids[p], others[q]), max(ids[p], others[q]), float(found[p, q])) for p, q in zip(at.tolist(), to.tolist(), strict=True) if (ids[p] < others[q] if x == y else ids[p] != others[q])]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in pairs], kind), pa.array([r[1] for r in pairs], kind), pa.array([r[2] for r in pairs], pa.float64())], ["a", "b", "similarity"])


def embedding_clusters(vectors: DataFrame, id_: str, vector: str, block: str, least: float = 0.85) -> DataFrame:
    """(id, cluster): the rows of a block that a chain of pairs above least joins, by
    their least id; every row has one."""
    pairs = alike(vectors, id_, vector, block, least).select("a", "b")
    whole = components(pairs).withColumnRenamed("node", "__n")
    return vectors.select(F.col(id_).alias("id")).join(whole, F.col("id") == F.col("__n"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


def skippable(patterns: DataFrame, coverage: DataFrame, never: list[str], least: float = 0.8) -> DataFrame:
    """Patterns that some tool covers well enough to skip, but those never to be skipped."""
    best = coverage.groupBy(F.col("pattern_id").alias("__p")).agg(F.max("precision").alias("precision")).where(F.col("precision") >= least)
    return patterns.where(~F.col("pattern_id").isin(never)).join(best, F.col("pattern_id") == F.col("__p")).drop("__p")


def mapped(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """findings with the pattern and confidence boost of their detector, null if unmapped."""
    m = mapping.select(F.col("detector").alias("__d"), "pattern_id", "boost")
    return findings.join(m, F.col("detector") == F.col("__d"), "left").drop("__d")


def resolve_rule(findings: DataFrame, rules: DataFrame, name: str = "check_id") -> DataFrame:
    """findings with rule_id: the rule of that id, else the longest rule id that is a
    suffix, else the last dotted part. Each distinct name is resolved once: its suffixes
    of the lengths that rule ids have meet the ids by equality. Rules are broadcast, names
    never are, however few of them there are."""
    ids = rules.select(F.col("id").alias("__r")).where("__r <> ''").distinct()
    lengths = ids.agg(F.collect_set(F.length("__r")).alias("__ls"))
    names = findings.select(F.col(name).alias("__f")).where("__f is not null").distinct()
    tails = names.join(F.broadcast(lengths)).select("__f", F.explode("__ls").alias("__l")).where(F.col("__l") <= F.length("__f"))
    tails = tails.select("__f", F.substr(F.col("__f"), F.length("__f") - F.col("__l") + 1).alias("__t"))
    best = tails.join(F.broadcast(ids), F.col("__t") == F.col("__r")).groupBy(F.col("__f").alias("__g")).agg(F.max(F.struct(F.length("__r").alias("l"), F.col("__r").alias("r"))).alias("__b"))
    best = best.select("__g", F.col("__b.r").alias("__best")).hint("merge")
    return findings.join(best, F.col(name) == F.col("__g"), "left").withColumn("rule_id", F.coalesce("__best", F.element_at(F.split(name, r"\."), -1))).drop("__g", "__best")


def jaccard_pairs(sets: DataFrame, id_: str, items: str, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard) of sets at least that alike, by prefix filtering: two such sets
    share one of the rarest items that fill 1 - least of either, so only those meet. Of
    those that meet only such go on to their full sets as may share enough: by the items
    after the first shared one, and by items whose bit of a 64-bit summary the other
    lacks. Neither bound drops a pair that is alike."""
    rows = sets.select(F.col(id_).alias("i"), F.array_distinct(items).alias("x")).where(F.size("x") > 0)
    each = rows.select("i", F.size("x").alias("n"), F.explode("x").alias("t"))
    own = Window.partitionBy("i")
    counted = each.join(each.groupBy("t").agg(F.count("*").alias("df")), "t")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(t), 64) as int))")
    ranked = counted.withColumn("r", F.row_number().over(own.orderBy("df", "t"))).withColumn("bits", F.bit_or(bit).over(own))
    heads = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("i", "t", "n", "r", "bits")
    other = heads.select(F.col("i").alias("j"), F.col("t").alias("u"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("bits").alias("cits"))
    after = F.least(F.col("n") - F.col("r"), F.col("m") - F.col("s")) + 1
    lacks = lambda p, q: F.bit_count(F.col(p).bitwiseAND(F.bitwise_not(q)))
    most = F.least(after, F.col("n") - lacks("bits", "cits"), F.col("m") - lacks("cits", "bits"))
    enough = most * (1 + least) >= (F.col("n") + F.col("m")) * least - 1e-9
    met = heads.join(other, (F.col("t") == F.col("u")) & (F.col("i") < F.col("j")) & (F.least("n", "m") >= F.greatest("n", "m") * least) & enough).select("i", "j").distinct()
    sized = met.join(rows, "i").join(rows.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    common = F.size(F.array_intersect("x", "y"))
    return sized.select(F.col("i").alias("a"), F.col("j").alias("b"), (common / (F.size("x") + F.size("y") - common)).alias("jaccard")).where(F.col("jaccard") >= least)
