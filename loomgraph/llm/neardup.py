"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with one and the same set
are a class, and only the least id of a class goes on. In each of TREES
independent trees a document goes from a node to BRANCH children, named by the
node and by the set's minwise shingle under a hash function of that child's
place in the tree: two sets of likeness J meet in a given child with probability
J, independently for all children.

Nodes of up to SMALL documents are compared exhaustively: pairs whose sketches
(the minwise shingles of all places) agree well enough are confirmed on the full
sets. In a larger node every document is compared with the least one, its hub;
nodes with the same hub are one group. Who is linked to the hub carries its label.
Of the documents near the hub, those with other labels are then compared with all
near ones on full sets, block against block, each block pair a product of two
incidence matrices in one task; linked ones are not compared with one another. The
others branch on to the next depth, the bands overlapping by more than the
distance of a linked pair. What is still large at the last depth is compared on
full sets. Documents that earlier links join carry one label; pairs of one label
are not compared again, and a node of one label is done.

Sketches and full sets lie in the shared folder in buckets by id, so that they
move once to a pair, not once for each join. Pairs of a frequent hub are salted.

With J = 0.8 a pair is in no common small node, near no common hub and in no
common node at the last depth with probability (1 - p)**4 = 1.2e-5, where p =
0.94 is the chance in one tree; it is missed by its sketch (fewer than half of 56
values equal) with probability 1e-7. A group of g documents that lie near one hub
and are mutually unlinked costs g**2 / BLOCK full sets dealt; README has a figure.

Nulls and ties. A null text, or one without words, has no shingle and is linked
with nothing. A document with fewer words than a shingle has one, of all of
them. A null id is in no class: its component is null and it is kept. Rows that
share an id have the component of their own text each; texts of which it is the
least id are linked. Ids are cast to bigint. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textvec import mix, shingles, slices, texts, words
from loomgraph.llm.workers import ready
from loomgraph.operators.components import components
from loomgraph.scratch import bucketed, table, work

TREES = 4
BRANCH = 2
DEPTH = 3
SMALL = 48
#: Documents, and shingles, of a block whose full sets are compared in one task with another's.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Ids that may be broadcast at once: 32 MB.
SENT = 4_000_000
#: Pairs of a hub in one task.
HOT = 1024
#: Agreement with a hub's sketch from which a document is near it, and up to which it branches on.
NEAR, FAR = 0.3, 0.75
#: Common values of two sketches, of all, from which a pair is confirmed on its sets.
SKETCH_LEAST = 0.5
_U, _H = np.uint64, np.uint32
_PLACES = sum(BRANCH ** (d + 1) for d in range(DEPTH))
KEPT = TREES * _PLACES
_ROOTS = np.array([t * _PLACES + b for t in range(TREES) for b in range(BRANCH)])
_SEEDS = np.random.RandomState(4242).randint(1, 2**62, (2, KEPT)).astype(_U) * _U(2) + _U(1)


def _sketch(own: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function, mixed down to 64 bits."""
    out = np.full(KEPT, np.iinfo(np.uint64).max, _U)
    for k in range(0, len(own), 4096):
        part = own[k : k + 4096]
        h = (part[None, :] ^ _SEEDS[0][:, None]) * _SEEDS[1][:, None]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        out = np.minimum(out, h.min(1))
    return out


def _packed(sketch: np.ndarray) -> bytes:
    """The lower halves of all values, then the upper halves of those that name the roots' children."""
    return np.concatenate([sketch.astype(_H), (sketch[_ROOTS] >> _U(32)).astype(_H)]).tobytes()


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _H).reshape(-1, KEPT + len(_ROOTS))


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = texts(column)
    for i, j in slices(offsets):
        names, rows, _ = words(data, offsets[i : j + 1])
        for run in shingles(names, rows, width):
            yield np.unique(run)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for own in _sets(batch.column("__text"), width):
                sizes.append(len(own))
                digests.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sketches.append(_packed(_sketch(own)) if len(own) else None)
            new = {"__n": pa.array(sizes, pa.int64()), "__digest": pa.array(digests, pa.binary()), "__sketch": pa.array(sketches, pa.binary())}
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *new.values()], [*rest, *new])

    return run


def _children(depth: int):
    """A row (node, slot, id) for each child that a document goes to from its node. A
    slot is a place in all trees at its depth; at depth 0 the roots are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s = _unpacked(batch.column("sketch"))
            at, above = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "node")) if depth else (np.tile(np.arange(TREES), n), np.zeros(n * TREES, np.int64))
            take = np.arange(n) if depth else np.repeat(np.arange(n), TREES)
            at, above, take = (np.repeat(x, BRANCH) for x in (at.astype(np.int64), above, take))
            branch = np.tile(np.arange(BRANCH), len(take) // BRANCH)
            tree, path = at // BRANCH**depth, at % BRANCH**depth
            value = s[take, tree * _PLACES + sum(BRANCH ** (d + 1) for d in range(depth)) + path * BRANCH + branch].astype(_U)
            if not depth:
                value |= s[take, KEPT + tree * BRANCH + branch].astype(_U) << _U(32)
            slot = at * BRANCH + branch
            node = mix(above.astype(np.int64).view(_U) * _U(31) + value + mix(((slot << 8) + depth).astype(_U)))
            index = pa.array(take)
            kept = [c for c in ("id", "label") if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(slot.astype(np.int32)), *(batch.column(c).take(index) for c in kept)], ["node", "slot", *kept])

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first width columns; such rows come one after another."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _compare(share: float):
    """Pairs of different labels whose sketches agree, from rows in order of node."""

    def pairs(held: list[tuple]) -> Iterator[tuple[int, int]]:
        ids, labels, n = (np.array([r[k] for r in held]) for k in (1, 2, 3))
        s = np.frombuffer(b"".join(r[4] for r in held), _H).reshape(len(held), -1)[:, :KEPT]
        for k in range(len(held) - 1):
            others = np.arange(k + 1, len(held))
            others = others[(labels[others] != labels[k]) & (ids[others] != ids[k]) & (np.minimum(n[others], n[k]) >= share * np.maximum(n[others], n[k]))]
            if len(others):
                for j in others[(s[others] == s[k]).mean(1) >= SKETCH_LEAST]:
                    yield int(min(ids[k], ids[j])), int(max(ids[k], ids[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for held in _groups(batches, ["node", "id", "label", "n", "sketch"], 1):
            found += pairs(held)
            if len(found) > 4096:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _linked(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of both sides are linked, as a matrix. Only elements of two sets or more are columns."""
    sets = left if left is right else [*left, *right]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, (c, c + 2048))
        x = np.zeros((len(sets), 2048), np.float32)
        x[rows[a:b], column[a:b] - c] = 1
        common += x[: len(left)] @ x[len(sets) - len(right) :].T
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    out = np.zeros(common.shape, bool)
    for k in range(len(left)):
        out[k] = (num + den) * common[k].astype(np.int64) >= num * (n[k] + m)
    return out


def _exact(num: int, den: int):
    """A spanning set of links between labels, from rows in order of (grp, left, right)."""

    def links(held: list[tuple]) -> Iterator[tuple[int, int]]:
        sides = [held, held] if held[0][1] == held[0][2] else [[r for r in held if r[5] == s] for s in held[0][1:3]]
        if not all(sides):
            return
        sets = [[np.frombuffer(r[6], _U) for r in side] for side in sides]
        met = _linked(sets[0], sets[0] if sides[0] is sides[1] else sets[1], num, den)
        (a, la), (b, lb) = ((np.array([r[3] for r in side]), np.array([r[4] for r in side])) for side in sides)
        for k in range(len(a)):
            for j in np.flatnonzero(met[k] & (lb != la[k])):
                if lb[j] != la[k]:
                    yield int(min(a[k], b[j])), int(max(a[k], b[j]))
                    old = lb[j]
                    la[la == old], lb[lb == old] = la[k], la[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, ["grp", "left", "right", "id", "label", "side", "set"], 3):
            if len(held) > 1:
                yield _pairs(list(links(held)))

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How well the sketches of hub and document agree."""
    for batch in batches:
        hub, own = (_unpacked(batch.column(c))[:, :KEPT] for c in ("sketch_a", "sketch_b"))
        agree = pa.array((own == hub).mean(1) if len(own) else [], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), agree], ["hub", "id", "hub_n", "n", "agree"])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _similar(own: np.ndarray, other: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(own, other, assume_unique=True))
    return den * common >= num * (len(own) + len(other) - common)


def _set_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([s.tobytes() for s in _sets(batch.column("__text"), width)], pa.binary())], ["i", "set"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x, _U), np.frombuffer(y, _U), num, den) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id (the least id
    that links reach, its own if none) and kept (it is that id), and the columns of
    carry. Two documents are linked if 100 * common >= percent * union of their sets
    of width-word shingles."""
    ready(docs.sparkSession)
    carried = {f"__c{k}": c for k, c in enumerate((carry or {}).values())}
    slim = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"), *(c.alias(n) for n, c in carried.items()))
    with work() as made:
        schema = ", ".join(f"{n} {kind}" for n, kind in slim.drop("__text").dtypes) + ", __n bigint, __digest binary, __sketch binary"
        described = table(slim.mapInArrow(_describe(width), schema), "described", made)
        told = table(described.drop("__sketch"), "told")
        classes = table(told.where("__id is not null and __n > 0").groupBy("__digest").agg(F.min("__id").alias("id"), F.count("*").alias("members")), "classes", made)
        links = _links(slim.select("__id", "__text"), described, classes, width, percent, made)
        whole = components(links).select(F.col("node").alias("x"), "component")
        # only classes that are more than one document on its own need a row
        of_class = classes.join(whole, F.col("id") == F.col("x"), "left").where("members > 1 or component is not null").select(F.col("__digest").alias("d"), F.coalesce("component", "id").alias("component"))
        of_class = table(of_class, "of_class")
    out = told.join(of_class, F.col("__digest") == F.col("d"), "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("component", "__id"))
    return out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"), *(F.col(n).alias(name) for n, name in zip(carried, carry or (), strict=True)))


def _links(slim: DataFrame, described: DataFrame, classes: DataFrame, width: int, percent: int, made: list) -> DataFrame:
    """Links (a, b) between the ids of classes, enough for their components."""
    spark = slim.sparkSession
    share = percent / 100
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    leads = classes.select("id", F.col("__digest").alias("d"))
    own = described.join(leads, (F.col("__id") == F.col("id")) & (F.col("__digest") == F.col("d")), "left_semi").dropDuplicates(["__id", "__digest"])
    sketches = bucketed(own.repartition(parts, "__id").select(F.col("__id").alias("i"), F.col("__n").alias("n"), F.col("__sketch").alias("sketch")), "i", "sketches", made)
    sets: DataFrame | None = None

    def kept(df: DataFrame, name: str) -> DataFrame:
        return table(df, name, made)

    def full_sets(ids: DataFrame) -> DataFrame:
        """The full sets of all documents that may be compared. Only their texts shuffle
        while the ids are few enough to be sent to all executors, else all texts do, once."""
        ids = kept(ids.distinct(), "needed")
        few = ids.limit(SENT + 1).count() <= SENT
        texts_of = slim.where("__id is not null").withColumnRenamed("__id", "i").join(F.broadcast(ids) if few else ids, F.col("i") == F.col("w"), "left_semi")
        texts_of = texts_of.repartition(parts, "i").withColumn("__same", F.xxhash64("__text")).dropDuplicates(["i", "__same", "__text"]).select("i", "__text")
        return bucketed(texts_of.mapInArrow(_set_bytes(width), "i bigint, set binary"), "i", "sets", made)

    def meet(pairs: DataFrame, things: DataFrame, run, schema: str) -> DataFrame:
        """run() over pairs (a, b) with the columns of both in things. Things of b move
        once a pair, those of a once for each HOT of its pairs."""
        hot = kept(pairs.groupBy(F.col("a").alias("h")).agg((F.ceil(F.count("*") / HOT)).cast("int").alias("salts")).where("salts > 1"), "hot")
        keyed = pairs.join(hot, F.col("a") == F.col("h"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
        keyed = kept(keyed, "keyed")
        names = [c for c in things.columns if c != "i"]
        first, second = (things.select("i", *(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")
        first = keyed.select("a", "salt").distinct().join(first, F.col("a") == F.col("i")).drop("i")
        second = keyed.join(second, F.col("b") == F.col("i")).drop("i")
        return second.join(first, ["a", "salt"]).drop("salt").mapInArrow(run, schema)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return kept(meet(pairs, sets, _confirm(percent, 100), "a bigint, b bigint").distinct(), "confirmed")

    def labels(found: DataFrame) -> DataFrame:
        """(x, l) for documents that have a lesser linked one: the least of these, or its
        own least one. Equal labels are linked; unequal ones may be."""
        least = found.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("m"))
        return kept(least.join(least.select(F.col("x").alias("y"), F.col("m").alias("l")), F.col("m") == F.col("y"), "left").select("x", F.coalesce("l", "m").alias("l")), "labels")

    def confirm(pairs: DataFrame) -> DataFrame:
        """First each document with the least it may be linked to, then what these links leave apart."""
        found = confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        label = labels(found)
        for side in ("a", "b"):
            pairs = pairs.join(label.select("x", F.col("l").alias(f"l{side}")), F.col(side) == F.col("x"), "left").drop("x")
        apart = pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        done = found.select(F.col("a").alias("x"), F.col("b").alias("y"))
        apart = kept(apart.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"), "apart")
        return found if apart.isEmpty() else found.unionByName(confirmed(apart))

    def small(rows: DataFrame) -> DataFrame:
        """Candidate pairs of small nodes (node, id, label)."""
        rows = rows.join(sketches, F.col("id") == F.col("i")).select("node", "id", "label", "n", "sketch")
        return rows.repartition(parts, "node").sortWithinPartitions("node", "id").mapInArrow(_compare(share), "a bigint, b bigint")

    def blocks(least: str, size: str, total: str) -> Column:
        return F.greatest(F.lit(least).cast("int"), F.ceil(F.col(size) / BLOCK).cast("int"), F.ceil(F.col(total) / BLOCK_SHINGLES).cast("int"))

    def exact(rows: DataFrame, own: DataFrame) -> DataFrame:
        """Links between labels in groups of any size, on full sets, a block against a
        block at a time. rows (grp, id, n, label); own (g, own): the label of a group
        within which nothing is compared."""
        sums = rows.groupBy("grp", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t")).join(own, F.col("grp") == F.col("g"), "left")
        inner = F.coalesce(F.col("label") == F.col("own"), F.lit(False))
        sums = sums.groupBy(F.col("grp").alias("k")).agg(F.first("own").alias("own"), F.count("*").alias("labels"), *(F.sum(F.when(who, F.col(c)).otherwise(0)).alias(f"{c}_{side}") for side, who in (("in", inner), ("out", ~inner)) for c in ("c", "t")))
        sums = sums.where("labels > 1").select("k", "own", blocks("1", "c_out", "t_out").alias("outs"), blocks("0", "c_in", "t_in").alias("ins"))
        dealt = rows.join(kept(sums, "sums"), F.col("grp") == F.col("k")).withColumn("inner", F.coalesce(F.col("label") == F.col("own"), F.lit(False)))
        side = F.when(F.col("inner"), F.col("outs") + F.pmod(F.xxhash64("id"), F.greatest(F.col("ins"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("outs"))).cast("int")
        dealt = kept(dealt.select("grp", "id", "label", "outs", "ins", "inner", side.alias("side")), "sides")
        meets = F.transform(F.sequence(F.lit(0), F.when(F.col("inner"), F.col("outs")).otherwise(F.col("outs") + F.col("ins")) - 1), lambda o: F.struct(F.least("side", o).alias("left"), F.greatest("side", o).alias("right")))
        dealt = dealt.select("grp", "id", "label", "side", F.explode(meets).alias("m")).select("grp", "m.left", "m.right", "id", "label", "side")
        dealt = dealt.join(sets, F.col("id") == F.col("i")).drop("i")
        return kept(dealt.repartition(parts, "grp", "left", "right").sortWithinPartitions("grp", "left", "right", "id").mapInArrow(_exact(percent, 100), "a bigint, b bigint").distinct(), "exact")

    links, rows = None, sketches.select(F.col("i").alias("id"), "sketch")
    for depth in range(DEPTH):
        label = F.col("label") if depth else F.col("id").alias("label")
        rows = kept(rows.mapInArrow(_children(depth), f"node bigint, slot int, id bigint{', label bigint' if depth else ''}"), "nodes")
        nodes = rows.groupBy(F.col("node").alias("k")).agg(F.count("*").alias("size"), F.min("id").alias("hub"), F.min(label).alias("low"), F.max(label).alias("high")).where("size > 1 and low <> high").select("k", "size", "hub")
        # from a table, so that the join's exchange of a frequent node can be split
        met = kept(rows.join(kept(nodes, "sizes"), F.col("node") == F.col("k")).drop("k"), "met")
        large = met.where(F.col("size") > SMALL)
        last = large.isEmpty()
        found = small(met.where(F.col("size") <= SMALL).select("node", "id", label))
        if not last:
            near = kept(meet(large.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sketches, _agree, "hub bigint, id bigint, hub_n bigint, n bigint, agree double"), "near")
            likely = (F.col("agree") >= SKETCH_LEAST) & (F.least("n", "hub_n") >= share * F.greatest("n", "hub_n"))
            found = found.unionByName(near.where(likely).select(F.col("hub").alias("a"), F.col("id").alias("b")))
        found = kept(found.distinct(), "pairs")
        if not depth:
            needed = [found.select(F.col("a").alias("w")), found.select("b")]
            # who branches on is in a large node now
            needed += [] if last else [near.select("id"), near.select("hub")]
            ids = needed[0]
            for more in needed[1:]:
                ids = ids.union(more)
            sets = full_sets(ids)
        found = confirm(found)
        links = found if links is None else links.unionByName(found)
        if last:
            break
        label = labels(links)
        hubs = near.groupBy("hub").agg(F.first("hub_n").alias("n")).select("hub", F.col("hub").alias("id"), "n", F.lit(1.0).alias("agree"))
        near = near.select("hub", "id", "n", "agree").unionByName(hubs).join(label, F.col("id") == F.col("x"), "left")
        near = kept(near.select("hub", "id", "n", "agree", F.coalesce("l", "id").alias("label")), "labelled")
        if depth < DEPTH - 1:
            own = near.where("hub = id").select(F.col("hub").alias("g"), F.col("label").alias("own"))
            links = links.unionByName(exact(near.where(F.col("agree") >= NEAR).select(F.col("hub").alias("grp"), "id", "n", "label"), own))
            rows = near.where(F.col("agree") < FAR)
        else:
            rows = near
        rows = large.select("node", "slot", F.col("id").alias("x"), F.col("hub").alias("y")).join(rows, (F.col("id") == F.col("x")) & (F.col("hub") == F.col("y")))
        if depth == DEPTH - 1:
            nothing = spark.createDataFrame([], "g bigint, own bigint")
            links = links.unionByName(exact(rows.select(F.col("node").alias("grp"), "id", "n", "label"), nothing))
        else:
            rows = rows.select("node", "slot", "id", "label").join(sketches.select("i", "sketch"), F.col("id") == F.col("i")).drop("i")
    return links
