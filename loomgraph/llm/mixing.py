"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; within
its source the smallest keys are taken until the source's budget is spent. Whole
epochs come first: a target of 2.4 times a source takes all of it twice and 0.4
of it by key. Keys come from a digest of the id, so reruns agree.

The rest of a budget is filled in rounds. A round takes, in order of key, the
documents no larger than what is left, up to the first that would exceed it; the
next round goes on behind that with what is then left. Rounds end when less than
SLACK of the target is left or no later document fits, so every document that
fits may use the remainder. The order within a source is never sorted as a whole:
sizes are summed by (source, bin of key), a running sum over the bins finds the
one bin in which the budget ends, and only that bin's documents are sorted. What
each source takes is a row; the documents meet it in a second pass over the texts,
which do not shuffle while these rows are few.

Nulls and ties. A null text has size 0 and the least weight. A null source is a
source, the last. A null id draws by its text. Equal keys go by id, size and a
digest of the text; of rows alike in all of these as many go in as the budget
holds. A source without words has target 0. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomgraph.llm.textvec import slices, texts, words
from loomgraph.llm.workers import ready
from loomgraph.scratch import table, work

BINS = 4096
#: Share of a target that may be left when the rounds end.
SLACK = 1e-3
#: Parts over which rows alike in all respects are counted.
PARTS = 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:] = True  # one for each code point beyond ASCII


def _measure(text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(text_col))
            size = np.zeros(len(offsets) - 1, np.int64)
            letters, chars = size.copy(), size.copy()
            for i, j in slices(offsets):
                raw, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                size[i:j] = np.diff(words(data, offsets[i : j + 1])[1])
                for out, mask in ((letters, _LETTER[raw]), (chars, (raw & 0xC0) != 0x80)):
                    total = np.concatenate([[0], np.cumsum(mask)])
                    out[i:j] = total[cut[1:]] - total[cut[:-1]]
            ties = [int(md5(x.as_py() or b"").hexdigest()[:15], 16) for x in batch.column(text_col).cast(pa.large_binary())]
            new = {"__tie": pa.array(ties, pa.int64()), "size": pa.array(size), "__weight": pa.array(0.25 + 0.75 * letters / np.maximum(chars, 1))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    return run


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size (words), __weight: a quality weight from 0.25 to 1, by the share
    of letters in the text, and __tie: a digest of the text."""
    ready(docs.sparkSession)
    schema = StructType([*docs.drop("size").schema.fields, StructField("size", LongType()), StructField("__weight", DoubleType()), StructField("__tie", LongType())])
    return docs.drop("size").mapInArrow(_measure(text_col, schema.names), schema)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """For each row (__source, __total): __target. Weights go round the sources in
    code-point order, null last; the sum of all sizes is shared by weight, no
    target is above most times its source, and what is over is shared anew.

    Sources fill in the order of (most * size / weight): those below the final
    level are full, the level of the first that is not full holds for the rest.
    Works on one row a source."""
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.expr(f"{most} * __total / __w"), F.col("__source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("__all", F.sum("__total").over(everything))
        .withColumn("__below", F.coalesce(F.sum(F.col("__total") * most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__all") - F.col("__below")).cast("double") / F.col("__left"))
        .withColumn("__open", F.col("__level") * F.col("__w") <= F.col("__total") * most)
        .withColumn("__k", F.row_number().over(order))
    )
    level = F.min(F.when(F.col("__open"), F.struct("__k", "__level"))).over(everything)["__level"]
    return filled.withColumn("__level", level).select("__source", "__total", F.least((F.col("__total") * most).cast("double"), F.coalesce(F.col("__level"), F.lit(0.0)) * F.col("__w")).alias("__target"))


def _taken(base: DataFrame, budgets: DataFrame, made: list) -> DataFrame:
    """A row for each source and round: (s, gap, from_bin, from_place, stop, last, met,
    of). A document is in if its size is at most gap, it comes after (from_bin,
    from_place) and its bin is before stop or its place at most last; of rows
    like last, met of `of` are in."""
    place = F.struct("__key", "__id", "size", "__tie")
    up_to = Window.partitionBy("__source").orderBy("__key", "__id", "size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    kind = base.select(place.alias("p")).schema["p"].dataType.simpleString()
    state = budgets.where("__rest > 0").select(F.col("__s").alias("s"), F.col("__rest").alias("gap"), (F.col("__target") * SLACK).alias("slack"), F.lit(None).cast("int").alias("from_bin"), F.lit(None).cast(kind).alias("from_place"))
    rounds: DataFrame | None = None
    while True:
        later = F.col("from_bin").isNull() | (F.col("__bin") >= F.col("from_bin")) & (F.col("from_place").isNull() | (place > F.col("from_place")))
        fits = base.join(state, F.col("__source").eqNullSafe(F.col("s"))).where((F.col("size") <= F.col("gap")) & later)
        bins = fits.groupBy("__source", "__bin").agg(F.sum("size").alias("n"), F.max("gap").alias("gap"))
        bins = bins.withColumn("after", F.sum("n").over(Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)))
        stops = table(bins.where("after > gap").groupBy(F.col("__source").alias("e")).agg(F.min("__bin").alias("stop"), F.min(F.col("after") - F.col("n")).alias("start")), "stops", made)
        edge = fits.join(stops, F.col("__source").eqNullSafe(F.col("e")) & (F.col("__bin") == F.col("stop")))
        edge = edge.withColumn("in", F.col("start") + F.sum("size").over(up_to) <= F.col("gap")).withColumn("place", place)
        alike = edge.groupBy("__source", "place").agg(F.count_if("in").alias("met"), F.count("*").alias("of"), F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("t"))
        ends = alike.groupBy(F.col("__source").alias("l")).agg(F.sum("t").alias("t"), F.max(F.when(F.col("met") > 0, F.struct("place", "met", "of"))).alias("x"))
        own = state.join(stops, F.col("s").eqNullSafe(F.col("e")), "left").join(ends, F.col("s").eqNullSafe(F.col("l")), "left")
        done = table(own.select("s", "gap", "slack", "from_bin", "from_place", "stop", "start", "t", F.col("x.place").alias("last"), F.col("x.met").alias("met"), F.col("x.of").alias("of")), "round", made)
        one = done.select("s", "gap", "from_bin", "from_place", "stop", "last", "met", "of")
        rounds = one if rounds is None else rounds.unionByName(one)
        left = F.col("gap") - F.col("start") - F.coalesce("t", F.lit(0))
        # without a last, all of the bins before stop were looked at
        state = done.where("stop is not null").select("s", left.alias("gap"), "slack", F.col("stop").alias("from_bin"), F.col("last").alias("from_place")).where("gap > slack")
        if state.isEmpty():
            return rounds


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs with size, source_size, target (of its source), copies (how often the
    mix has it) and taken (copies * size); columns of those names are replaced."""

    def drawn(rows: DataFrame) -> DataFrame:
        rows = measured(rows, text_col)
        name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.col("__tie").cast("string")))
        draw = (F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        rows = rows.withColumn("__key", -F.log(draw) / F.col("__weight")).drop("__weight")
        return rows.withColumn("__bin", F.floor((1 - F.exp(-F.col("__key"))) * BINS).cast("int"))

    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    with work() as made:
        base = table(drawn(docs.select(id_col, source_col, text_col)).select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), "size", "__tie", "__key", "__bin"), "mix", made)
        targets = source_targets(base.groupBy("__source").agg(F.sum("size").alias("__total")), weights, most)
        spent = targets.withColumn("__epochs", F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0)).cast("int"))
        spent = table(spent.withColumn("__rest", F.col("__target") - F.col("__epochs") * F.col("__total")).withColumnRenamed("__source", "__s"), "spent", made)
        rounds = _taken(base, spent, made)
        each = rounds.groupBy("s").agg(F.collect_list(F.struct("gap", "from_bin", "from_place", "stop", "last", "met", "of")).alias("__rounds"))
        plan = table(spent.join(each, F.col("__s").eqNullSafe(F.col("s")), "left").select("__s", "__total", "__target", "__epochs", "__rounds"), "plan")
    tied = not plan.where(F.exists("__rounds", lambda r: F.coalesce(r["met"] < r["of"], F.lit(False)))).isEmpty()
    out = drawn(docs).join(plan, F.col(source_col).eqNullSafe(F.col("__s")))
    place = F.struct(F.col("__key"), F.col(id_col).alias("__id"), F.col("size"), F.col("__tie"))

    def inside(r):
        later = r["from_bin"].isNull() | (F.col("__bin") >= r["from_bin"]) & (r["from_place"].isNull() | (place > r["from_place"]))
        ends = r["stop"].isNull() | (F.col("__bin") < r["stop"]) | F.coalesce(place <= r["last"], F.lit(False))
        return (F.col("size") <= r["gap"]) & later & ends

    some = F.filter("__rounds", lambda r: F.coalesce((r["met"] < r["of"]) & (place == r["last"]), F.lit(False)))
    more = F.coalesce(F.exists("__rounds", inside), F.lit(False)).cast("int")
    if tied:
        out = out.withColumn("__met", F.get(some, F.lit(0))["met"])
        alike = _counted(out.where("__met is not null"), source_col)
        out = out.where("__met is null").withColumn("__more", more).drop("__met").unionByName(alike)
    else:
        out = out.withColumn("__more", more)
    out = out.withColumn("copies", F.col("__epochs") + F.col("__more"))
    return out.select(*docs.columns, "size", F.col("__total").alias("source_size"), F.col("__target").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _counted(alike: DataFrame, source_col: str) -> DataFrame:
    """Rows alike in a source, __met of which go in: numbered over parts, so that no
    task holds all of them. They are written first: a row keeps its part."""
    own = [source_col, "__key", "__tie", "size"]
    alike = table(alike.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).withColumn("__at", F.monotonically_increasing_id()), "alike")
    parts = alike.groupBy(*own, "__part").agg(F.count("*").alias("__in"))
    before = F.sum("__in").over(Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in")
    before = table(parts.select(*(F.col(c).alias(f"__k{k}") for k, c in enumerate(own)), F.col("__part").alias("__p"), before.alias("__before")), "parts")
    same = [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(own)]
    row = F.row_number().over(Window.partitionBy(*own, "__part").orderBy("__at"))
    out = alike.withColumn("__row", row).join(before, [*same, F.col("__part") == F.col("__p")])
    return out.withColumn("__more", (F.col("__before") + F.col("__row") <= F.col("__met")).cast("int")).drop("__met", "__part", "__at", "__row", "__p", "__before", *(f"__k{k}" for k in range(len(own))))
