"""Counts of features in rows of text, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textvec import slices, texts

#: Rows of a count matrix that is made at a time.
ROWS = 128


#: Rows by buckets from the bytes and offsets of some texts.
Counts = Callable[[np.ndarray, np.ndarray], np.ndarray]


def row_counts(column: pa.Array, counts: Counts) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, counts) for consecutive row ranges of a text column."""
    data, offsets = texts(column)
    for i, j in slices(offsets):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            yield a, b, counts(data, offsets[a : b + 1])


def sparse_rows(text_col: str, keep: list[str], counts: Counts):
    """For mapInArrow: the columns of keep, and the non-zero counts as bytes (at: uint16, n: float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for _, _, made in row_counts(batch.column(text_col), counts):
                for row in made:
                    k = np.flatnonzero(row)
                    at.append(k.astype(np.uint16).tobytes())
                    n.append(row[k].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(at, pa.binary()), pa.array(n, pa.binary())], [*keep, "at", "n"])

    return run


def dense(rows: list, buckets: int) -> np.ndarray:
    out = np.zeros((len(rows), buckets), np.float32)
    for k, r in enumerate(rows):
        out[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
    return out


def drawn(rows: DataFrame, id_col: str, group: Column, most: int) -> DataFrame:
    """About most rows of each group at the most, by a digest of the id: the same
    rows on every run. The counts of the groups come to the driver, so groups
    must be few (labels, languages)."""
    counts = {r["g"]: r["count"] for r in rows.select(group.cast("string").alias("g")).groupBy("g").count().collect()}
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30))
    keep = F.lit(False)
    for g, n in sorted((str(g), n) for g, n in counts.items() if g is not None):
        keep = F.when(group.cast("string") == g, share < int((1 << 30) * min(1.0, most / n))).otherwise(keep)
    return rows.where(keep)
