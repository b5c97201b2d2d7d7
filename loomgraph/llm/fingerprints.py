"""Document fingerprints by locally consistent parsing.

A text's bytes are the names of level 0. On each level runs of one name are
merged, deterministic coin tossing (the place and value of the lowest bit in
which a name differs from the one before, four times, then down to three
labels) finds local extremes, and the text is cut there into phrases of a few
names, each of which gets a name of its own. Where to cut depends on a few
neighbours only, so equal substrings have equal phrases inside, whatever their
offset. A fingerprint is the KEPT least phrase names of levels 3 and 4, as hex:
the likeness of two is the share of common names among the least of both.

Nulls and ties. A null text is empty; its fingerprint is "", like only another
empty one (1.0). Texts of a few bytes are one phrase. Rows go by descending id,
null ids last; rows that share an id go by text. An empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.textvec import _BYTE, mix
from loomgraph.llm.workers import ready

LEVELS = (3, 4)
KEPT = 64
#: Bytes of text parsed at a time; a longer text is parsed alone.
GROUP_BYTES = 1 << 17
_U = np.uint64
_MEX = np.array([0, 1, 0, 2, 0, 1, 0, 3], np.uint8)  # least of 0, 1, 2 that a mask of neighbours leaves


def _coin(now: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest place where two unequal names differ, plus the bit there."""
    one = now.dtype.type(1)
    x = now ^ before
    place = np.bitwise_count((x & (~x + one)) - one).astype(now.dtype)
    place[first] = 0
    return (place + place + ((now >> place) & one)).astype(np.uint8)


def _level(names: np.ndarray, begins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and which of them begin a text."""
    new = begins.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(names))
    unit, first = names[at], begins[at]
    many = run > 1
    unit[many] = mix(unit[many] + run[many].astype(_U) * _U(0x9E3779B97F4A7C15))
    n = len(unit)
    label = _coin(unit, np.concatenate([unit[:1], unit[:-1]]), first)
    for _ in range(3):
        label = _coin(label, np.concatenate([label[:1], label[:-1]]), first)
    final = np.zeros(n, bool)
    final[:-1] = first[1:]
    final[-1] = True
    bit = np.left_shift(1, label).astype(np.uint8)
    for c in (3, 4, 5):  # no two neighbours have the same label, so each may take a free one
        where = np.flatnonzero(label == c)
        left = np.where(first[where], 0, bit[where - 1])
        right = np.where(final[where], 0, bit[np.minimum(where + 1, n - 1)])
        label[where] = _MEX[(left | right) & 7]
        bit[where] = np.left_shift(1, label[where])
    left, right = np.empty(n, np.int8), np.empty(n, np.int8)
    mid = label.astype(np.int8)
    left[1:], left[0], right[:-1], right[-1] = mid[:-1], 9, mid[1:], 9
    inner = ~(first | final)
    top = inner & (mid > left) & (mid > right)
    low = inner & (mid < left) & (mid < right)
    low[1:] &= ~top[:-1]
    low[:-1] &= ~top[1:]
    cut = np.flatnonzero(top | low | first)
    place = np.arange(n) - np.repeat(cut, np.diff(cut, append=n))
    step = np.multiply.accumulate(np.full(int(place.max()) + 1, 0xD6E8FEB86659FD93, _U))
    return mix(np.add.reduceat(unit * step[place], cut) + _U(level)), first[cut]


def fingerprint_names(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the KEPT least 32-bit phrase names, ascending."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return out
    data = np.frombuffer(b"".join(texts[k] for k in full), np.uint8)
    begins = np.zeros(len(data), bool)
    begins[np.cumsum([0, *(len(texts[k]) for k in full[:-1])])] = True
    names, found = _BYTE[data], []
    for level in range(1, max(LEVELS) + 1):
        names, begins = _level(names, begins, level)
        if level in LEVELS:
            cut = [*np.flatnonzero(begins).tolist(), len(names)]
            found.append(((names >> _U(32)).astype(np.uint32), cut))
    for i, k in enumerate(full):
        out[k] = np.unique(np.concatenate([x[cut[i] : cut[i + 1]] for x, cut in found]))[:KEPT]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the KEPT least of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:KEPT]
    return float(np.isin(least, np.intersect1d(a, b)).mean())


def to_hex(names: np.ndarray) -> str:
    return names.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _walk(names: list[str]):
    """Rows come by bucket in order; each meets the next row of its bucket. The last
    row of a bucket, marked, is only the one that the row before it meets."""

    def flush(held: list[tuple]) -> tuple[list[tuple], pa.RecordBatch]:
        texts = [t.encode() for _, _, _, t in held]
        pairs = [(k, edited(held[k][3], held[k + 1][3])) for k in range(len(held) - 1) if not held[k][1] and held[k][0] == held[k + 1][0]]
        marks = fingerprint_names(texts + [e.encode() for _, e in pairs])
        rows = []
        for j, (k, e) in enumerate(pairs):
            own, other = marks[k], marks[len(texts) + j]
            rows.append((held[k][2], len(held[k][3]), sha256(e.encode()).hexdigest(), to_hex(own), to_hex(other), likeness(own, other), likeness(own, marks[k + 1])))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return held[-1:], columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field("__id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("__bucket", "__mark", "__id", "__text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= GROUP_BYTES and len(held) > 1:
                    held, columns = flush(held)
                    size = len(held[0][3])
                    yield _batch(columns, names, kind)
        if len(held) > 1:
            yield _batch(flush(held)[1], names, kind)

    return run


def _batch(columns: list, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, where the next document is the one
    with the next lower id, and for the last one the first.

    Ids are dealt to ranges by their quantiles. The first document of a range is
    also sent to the range before it, so that no order over the whole is needed;
    of each range only the greatest id comes to the driver."""
    spark = docs.sparkSession
    ready(spark)
    slim = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = parts * 4
    cuts = sorted(set(slim.agg(F.percentile_approx("__id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []))
    bound = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    # 0 has the greatest ids; the last has the null ones
    bucket = F.when(F.col("__id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bound, lambda c: c > F.col("__id")))).cast("int")
    heads = sorted((r["__bucket"], r["top"]) for r in slim.select(bucket.alias("__bucket"), "__id").groupBy("__bucket").agg(F.max("__id").alias("top")).collect())
    kind = dict(slim.dtypes)["__id"]
    # a row for each range, so the table is small whatever the input
    to = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], f"__head {kind}, __to int")
    rows = slim.withColumn("__bucket", bucket).withColumn("__mark", F.lit(False))
    # a bucket of null ids sends its first row only; all share the id
    order = Window.partitionBy("__bucket").orderBy("__text")
    marks = slim.join(F.broadcast(to), F.col("__id").eqNullSafe(F.col("__head"))).select("__id", "__text", F.col("__to").alias("__bucket"), F.lit(True).alias("__mark"))
    marks = marks.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    together = rows.unionByName(marks).repartition(parts, "__bucket").sortWithinPartitions("__bucket", "__mark", F.col("__id").desc_nulls_last(), "__text")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return together.mapInArrow(_walk(names), f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
