"""Quality classification by nearest-neighbour voting in a latent semantic space.

At most PER_LABEL labelled texts of each label, whole texts, give hashed byte
n-gram counts; a truncated singular value decomposition of their tf-idf rows
gives the space. After the byte n-grams there is one count of words that equal
the word before. The vectors of these texts (PER_LABEL x labels x WIDTH floats)
are broadcast; every document is projected, multiplied with all of them block
by block, and its NEIGHBOURS largest cosines vote with a weight that falls with
the distance.

Nulls and ties. A null or empty text, and every text if there are no labels,
has the share of label 1 in the training sample (0.5 without one) as its score.
Null labels and ids are not learned from; a document with two labels votes with
both. Among equal cosines the choice does not depend on the data's layout in
rows, only on the sample's order by id. Columns score and predicted of the
input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomgraph.llm.grams import dense, drawn, row_counts, sparse_rows
from loomgraph.llm.textvec import gram_counts, words
from loomgraph.llm.workers import ready

PER_LABEL = 2000
BUCKETS = 4096
#: The buckets, and the count of repeated words.
FEATURES = BUCKETS + 1
SIZES = (1, 2, 3)
WIDTH = 48
NEIGHBOURS = 25
#: A repeated word counts as so many n-grams, about as many as it has.
REPEAT = 15
#: Fall of a vote with the distance 1 - cosine.
FALL = 0.05


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray  # FEATURES x WIDTH
    vectors: np.ndarray  # sample x WIDTH
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_tfidf(counts, self.idf) @ self.space)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        cosines = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.exp((np.take_along_axis(cosines, near, 1).astype(np.float64) - 1) / FALL)
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty((len(offsets) - 1, FEATURES), np.float32)
    out[:, :BUCKETS] = gram_counts(data, offsets, SIZES, BUCKETS, False)
    names, rows, _ = words(data, offsets)
    again = np.zeros(len(names) + 1, np.int64)
    again[2:] = np.cumsum(names[1:] == names[:-1])
    first = np.minimum(rows[:-1] + 1, rows[1:])
    out[:, BUCKETS] = REPEAT * (again[rows[1:]] - again[first])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of the shares: long and short texts of a kind fall together."""
    return _unit(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * idf)


def train(counts: np.ndarray, labels: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.RandomState(seed)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.3).astype(np.float32)
    x = _tfidf(counts, idf)
    width = min(WIDTH, *x.shape)
    q = np.linalg.qr(x @ rng.normal(size=(x.shape[1], width + 8)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    space = np.linalg.svd(q.T @ x, full_matrices=False)[2][:width].T.astype(np.float32)
    return Model(idf, space, _unit(x @ space), labels.astype(np.float64), float(labels.mean()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model | None:
    """Learns from the rows of labels; the caller leaves out what is held out."""
    ready(docs.sparkSession)
    told = labels.select(F.col(id_col).alias("__lid"), F.col(label_col).cast("double").alias("__label")).where("__lid is not null and __label is not null").distinct()
    sample = drawn(told, "__lid", F.col("__label"), per_label)  # per_label rows a label: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null and __text <> ''")
    rows = rows.join(F.broadcast(sample), F.col("__id") == F.col("__lid")).select("__id", "__text", "__label")
    got = rows.mapInArrow(sparse_rows("__text", ["__id", "__label"], _counts), f"__id {dict(rows.dtypes)['__id']}, __label double, at binary, n binary").collect()
    got = sorted(got, key=lambda r: (r["__id"], r["__label"], r["at"], r["n"]))
    return train(dense(got, FEATURES), np.array([r["__label"] for r in got])) if got else None


def _score(model, text_col: str, least: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            score = np.full(batch.num_rows, m.prior if m else 0.5)
            for a, b, counts in row_counts(batch.column(text_col), _counts) if m else ():
                some = counts.any(1)
                if some.any():
                    score[a:b][some] = m.scores(counts[some])
            score = np.clip(score, 0, 1)
            new = {"score": pa.array(score), "predicted": pa.array((score >= least).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    return run


def classify(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= least)."""
    ready(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), text_col, least, schema.names), schema)
