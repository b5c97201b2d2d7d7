"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import drop, table


def components(links: DataFrame) -> DataFrame:
    """links (a, b): a row (node, component) for each node that occurs, component
    being the least node it is linked to over any path. Large-star and small-star
    rounds: every round each node's neighbours are hung below the least of them,
    until all links are stars. A round shuffles the links twice; a chain of n
    nodes takes about log n rounds."""
    made: list = []
    edges = table(links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links", made)  # v < u
    while True:
        # large star: of a node's neighbours the greater ones are hung below the least one (or the node)
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.where("m > n").join(low.withColumnRenamed("n", "k"), F.col("n") == F.col("k")).select(F.col("low").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: a node and its lesser neighbours are hung below the least of these
        large = table(large, "large", made)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        small = joined.select(F.col("low").alias("v"), F.col("v").alias("u")).where("v <> u").union(low.select(F.col("low").alias("v"), "u")).distinct()
        before, made = made, []
        after = table(small, "links", made)
        drop(before)
        # done if all links are stars: no node is both above and below, and each hangs below one
        seen = after.select(F.col("v").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("u", F.lit(0), F.lit(1)))
        if seen.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or up > 0 and down > 0").isEmpty():
            break
        edges = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
