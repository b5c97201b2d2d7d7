"""Line dedup: lines that many documents share stay in one of them.

Two Bloom filters, for hashes seen once and seen twice, find the lines that may
repeat. Every partition fills its own pair and sends only the positions of the
bits it set, block by block; a block's owner turns bits that two partitions set
into bits of the second filter. Only lines the second filter holds (true repeats
and its few errors) shuffle, as 128-bit digests, for exact confirmation and the
choice of the document that keeps them. Texts do not shuffle: the keys to drop,
with the id that keeps each, are sent to where the texts are read.

Two sizes are checked, each with another way beyond it. A filter holds MAX_BITS at
most, good for some 107 million lines; beyond that its errors rise and more
digests shuffle, in the end those of all lines (README has the figure), with the
same result. Up to SENT shared keys are sent to all executors; beyond that the
documents shuffle once, to meet their keys.

Nulls and ties. A null text is one empty line. Documents with a null id neither
count nor lose lines. Rows that share an id count as one document and all lose
or keep a line together. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgraph.llm.workers import ready
from loomgraph.scratch import table

#: 128 MB for the filter that is sent to executors.
MAX_BITS = 1 << 30
BITS_PER_LINE = 10
#: Shared keys that may be broadcast: 24 bytes each.
SENT = 2_000_000
PROBES = 4
BLOCK = 1 << 16
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """What makes two lines equal, or None if the line is too short to count."""
    key = line.strip(_STRIP).lower()  # of bytes: only A-Z change
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


def _blocks(positions: np.ndarray) -> dict[int, bytes]:
    positions = np.unique(positions)
    block = (positions // np.uint64(BLOCK)).astype(np.int64)
    cut = np.flatnonzero(np.diff(block)) + 1
    low = (positions % np.uint64(BLOCK)).astype(np.uint16)
    return {int(block[a]): low[a:b].tobytes() for a, b in zip([0, *cut], [*cut, len(block)], strict=True) if b > a}


def _column(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for x in batch.column(name).cast(pa.large_binary()):
        yield x.as_py() or b""


def _fill(min_chars: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for text in _column(batch, "__text"):
                keys = {key for line in text.split(b"\n") if (key := line_key(line, min_chars)) is not None}
                if keys:
                    seen.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
        if not seen:
            return
        hashes, counts = np.unique(np.concatenate(seen), return_counts=True)
        once, twice = _blocks(_probes(hashes, bits).ravel()), _blocks(_probes(hashes[counts > 1], bits).ravel())
        ids = sorted(once)
        for k in range(0, len(ids), 1024):
            part = ids[k : k + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([once[b] for b in part], pa.binary()), pa.array([twice.get(b, b"") for b in part], pa.binary())], ["block", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = state.setdefault(block, np.zeros(BLOCK, np.uint8))
            p = np.frombuffer(once, np.uint16)
            at[p] = np.minimum(at[p] + 1, 2)
            at[np.frombuffer(twice, np.uint16)] = 2
    for block, at in state.items():
        if (at > 1).any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(at > 1).tobytes()], pa.binary())], ["block", "bits"])


def _held(hashes: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    p = _probes(hashes, bits)
    return (held[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))) & 1).all(0)


def _suspected(text: bytes, min_chars: int, bits: int, held: np.ndarray) -> tuple[list[bytes], list[bytes | None], list[bytes]]:
    """A text's lines, their keys, and the distinct keys that the filter of repeats holds."""
    lines = text.split(b"\n")
    keys = [line_key(line, min_chars) for line in lines]
    own = list({key for key in keys if key is not None})
    if not own:
        return lines, keys, own
    met = _held(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), bits, held)
    return lines, keys, [own[k] for k in np.flatnonzero(met)]


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _suspects(min_chars: int, bits: int, filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("__id").to_pylist(), _column(batch, "__text"), strict=True):
                own = _suspected(text, min_chars, bits, held)[2]
                ids += [doc] * len(own)
                keys += map(_digest, own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("__id").type), pa.array(keys, pa.binary())], ["__id", "__key"])

    return run


def _drop(min_chars: int, id_col: str, text_col: str, names: list[str], bits: int, filter_, shared_):
    """Drops a text's lines whose keys another document keeps. Where shared_ (all
    keys in order, and who keeps them) is None, each row brings its own as __keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(filter_.value, np.uint8)
        known, keeps = (np.frombuffer(shared_.value[0], "S16"), shared_.value[1]) if shared_ else (None, None)
        for batch in batches:
            out, total, gone = [], [], []
            brought = batch.column("__keys").to_pylist() if shared_ is None else [None] * batch.num_rows
            for doc, text, mine in zip(batch.column(id_col).to_pylist(), _column(batch, text_col), brought, strict=True):
                lines, keys, own = text.split(b"\n"), [], []
                if mine or shared_ and len(known) and doc is not None:
                    lines, keys, own = _suspected(text, min_chars, bits, held)
                drop = set()
                if own:
                    digests = list(map(_digest, own))
                    if mine:
                        mine = set(mine)
                        drop = {key for key, d in zip(own, digests, strict=True) if d in mine}
                    else:
                        asked = np.array(digests, "S16")
                        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                        drop = {own[k] for k in np.flatnonzero(known[at] == asked) if keeps[at[k]] != doc}
                kept = [x for x, key in zip(lines, keys, strict=True) if key not in drop] if drop else lines
                out.append(b"\n".join(kept))
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            new = {text_col: pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n) if n in batch.schema.names else None) for n in names], names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with shared lines dropped, and n_lines (before) and n_dropped; columns
    of those names are replaced, all others stay.

    A line's key is the line without ASCII white space at its ends and with A-Z
    folded. A key of at least min_chars code points that at least min_docs
    documents hold stays only in the document with the largest id."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.drop("n_lines", "n_dropped")
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    known = slim.where("__id is not null and __text is not null")
    lines = known.agg(F.sum(F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MAX_BITS, max(BLOCK, 1 << (BITS_PER_LINE * lines - 1).bit_length() if lines else BLOCK))
    filled = known.select("__text").mapInArrow(_fill(min_chars, bits), "block int, once binary, twice binary")
    parts = max(1, min(bits // BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    held = np.zeros(bits // 8, np.uint8)
    for row in filled.repartition(parts, "block").mapInArrow(_merge, "block int, bits binary").toLocalIterator():
        held[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    kind = slim.schema["__id"].dataType.simpleString()
    filter_ = spark.sparkContext.broadcast(held.tobytes())
    suspects = table(known.mapInArrow(_suspects(min_chars, bits, filter_), f"__id {kind}, __key binary"), "lines")
    shared = table(suspects.groupBy("__key").agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__keep")).where(F.col("__n") >= min_docs).select("__key", "__keep"), "shared")
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if shared.limit(SENT + 1).count() <= SENT:
        own = shared.toArrow()
        keys = np.array(own.column("__key").to_pylist(), "S16")
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order].tobytes(), np.array(own.column("__keep").to_pylist())[order]))
        return docs.mapInArrow(_drop(min_chars, id_col, text_col, schema.names, bits, filter_, sent), schema)
    drops = suspects.join(shared, "__key").where(F.col("__id") != F.col("__keep")).groupBy(F.col("__id").alias("__did")).agg(F.collect_set("__key").alias("__keys"))
    joined = docs.join(drops, docs[id_col] == drops["__did"], "left").drop("__did")
    return joined.mapInArrow(_drop(min_chars, id_col, text_col, schema.names, bits, filter_, None), schema)
