"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The n-grams of SEED words of all benchmark items are looked up in every text,
and every one is a seed: one that a text shares with an item opens a window
around the place where the item would lie. The window's words and the item's
are aligned, and the score is the best local alignment's as a share of the
score of a verbatim copy. Edits, insertions and gaps lower it gradually. Common
n-grams cost little: no alignment scores more than the item's words that the
text holds, so most of what they open is left before it is aligned. A copy
without one whole n-gram of its item is not found.

Words are runs of ASCII letters and digits and of characters beyond ASCII that are
no punctuation. In scripts without blanks (ideographs, kana, Thai, Lao, Khmer,
Burmese) every two characters in a row are a word: single ones are so few that
texts with nothing in common would align.

The index of the benchmark is broadcast in blocks of at most BLOCK_ITEMS items,
so a larger benchmark takes more passes, never more memory.

Nulls and ties. A null text is empty and holds nothing; a null item text or id
is no item. Of equal scores of an item in a text the first place counts. Rows
are judged one by one, so ids may repeat or be null. An item of fewer words than
a seed is found only in a text that has just its words, as texts use one or two
words of any item without holding it. Empty tables give no
matches and drop nothing. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textvec import WORD_GAPS, shingles, slices, texts, words
from loomgraph.llm.workers import ready

SEED = 3
LEAST = 0.5
BLOCK_ITEMS = 5000
MATCH, MISMATCH, GAP = 2, -1, 1


@dataclass
class Index:
    items: list[int]
    names: list[np.ndarray]  # the words of each item
    grams: np.ndarray  # sorted names of all n-grams
    first: np.ndarray  # where each n-gram's postings begin
    item: np.ndarray  # postings
    place: np.ndarray


def build(items: list[tuple[int, str]], width: int = SEED) -> Index:
    column = pa.array([t for _, t in items], pa.large_string())
    data, offsets = texts(column)
    names, rows, _ = words(data, offsets, WORD_GAPS, pairs=True)
    runs = list(shingles(names, rows, width))
    gram = np.concatenate([*runs, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    place = np.concatenate([np.arange(len(r)) for r in runs] + [np.zeros(0, np.int64)]).astype(np.int64)
    order = np.lexsort((place, item, gram))
    grams, first = np.unique(gram[order], return_index=True)
    return Index([i for i, _ in items], [names[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)], grams, np.append(first, len(gram)), item[order], place[order])


def align(item: np.ndarray, window: np.ndarray) -> int:
    """Best local alignment score of two sequences of names."""
    step = np.arange(len(window)) * GAP
    above, best = np.zeros(len(window) + 1, np.int64), 0
    for name in item:
        row = np.maximum(above[:-1] + np.where(window == name, MATCH, MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + step) - step
        above[1:] = row
        best = max(best, int(row.max()))
    return best


def _hits(index: Index, column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, the row's words, n-grams of the index that it holds, their places) for rows with any."""
    data, offsets = texts(column)
    for i, j in slices(offsets):
        names, rows, _ = words(data, offsets[i : j + 1], WORD_GAPS, pairs=True)
        for k, run in enumerate(shingles(names, rows, width)):
            if not len(run) or not len(index.grams):
                continue
            at = np.minimum(np.searchsorted(index.grams, run), len(index.grams) - 1)
            places = np.flatnonzero(index.grams[at] == run)
            if len(places):
                yield i + k, names[rows[k] : rows[k + 1]], at[places], places


def matches(index: Index, names: np.ndarray, grams: np.ndarray, places: np.ndarray, least: float) -> Iterator[tuple[int, float, int]]:
    """(item, score, first word of the window) for each item found in a text."""
    n = index.first[grams + 1] - index.first[grams]
    where = np.repeat(places, n)
    post = np.concatenate([np.arange(index.first[g], index.first[g + 1]) for g in grams])
    item, shift = index.item[post], where - index.place[post]
    order = np.lexsort((shift, item))
    item, shift = item[order], shift[order]
    found, first = np.unique(item, return_index=True)
    # an item of which the text holds too few words cannot reach least
    lengths = np.array([len(index.names[k]) for k in found])
    held = np.isin(np.concatenate([index.names[k] for k in found]), names)
    enough = np.add.reduceat(held, np.cumsum(lengths) - lengths, dtype=np.int64) >= least * lengths
    for k, a, b in zip(found[enough], first[enough], np.append(first[1:], len(item))[enough], strict=True):
        own = index.names[k]
        shifts = np.unique(shift[a:b])
        best = (0.0, 0)
        # seeds that put the item at nearly the same place share a window
        for group in np.split(shifts, np.flatnonzero(np.diff(shifts) > len(own)) + 1):
            begin = max(0, int(group[0]) - len(own) // 2)
            window = names[begin : int(group[-1]) + len(own) + len(own) // 2 + 1]
            if np.count_nonzero(np.isin(own, window)) < least * len(own):
                continue
            score = align(own, window) / (MATCH * len(own))
            best = max(best, (score, -begin))
        if best[0] >= least:
            yield index.items[k], best[0], -best[1]


def _report(index, width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *found) for k, *hit in _hits(index.value, batch.column("__text"), width) for found in matches(index.value, *hit, least)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], ["__id", "item_id", "score", "start_word"]
            )

    return run


def _clean(index, text_col: str, width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, *hit in _hits(index.value, batch.column(text_col), width):
                keep[k] = next(matches(index.value, *hit, least), None) is None
            yield batch.filter(pa.array(keep))

    return run


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, width: int) -> Iterator:
    """A broadcast index for each block of items."""
    ready(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    blocks = -(-items.count() // BLOCK_ITEMS)
    context = docs.sparkSession.sparkContext
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        yield context.broadcast(build(sorted((r["i"], r["t"]) for r in own), width))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = SEED, least: float = LEAST) -> DataFrame:
    """A row for each document and item that it holds: id_col, item_id, score (least
    to 1) and start_word, where the window of the best alignment begins."""
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = f"__id {dict(slim.dtypes)['__id']}, item_id bigint, score double, start_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(docs, benchmark, item_col, item_text, width):
        out = out.unionByName(slim.mapInArrow(_report(index, width, least), schema))
    return out.withColumnRenamed("__id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = SEED, least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no item."""
    out = docs
    for index in _indexes(docs, benchmark, item_col, item_text, width):
        out = out.mapInArrow(_clean(index, text_col, width, least), docs.schema)
    return out
