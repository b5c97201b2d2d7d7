"""Language identification: the mean of hashed subword embeddings, a linear
softmax, and rejection by a calibrated score.

Subwords are runs of 1 to 4 bytes of the text with A-Z folded, white space and
digits as blanks. Embeddings and softmax are trained by stochastic gradient
descent in numpy on at most PER_LANGUAGE texts of each language, whole texts;
a fifth of them is kept for the temperature and for the score below which a
text is rejected. Both layers are linear, so a text is scored by one product of
its counts with (embeddings x softmax).

Nulls and ties. A text that is null or has no letter is "und", score 0, and
rejected. Equal probabilities go to the language first in code-point order. A
null language or id is not learned from. Without labelled rows all texts are
"und". Columns lang_pred, score and rejected of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from loomgraph.llm.grams import dense, drawn, row_counts, sparse_rows
from loomgraph.llm.textvec import gram_counts, texts
from loomgraph.llm.workers import ready

PER_LANGUAGE = 800
BUCKETS = 4096
SIZES = (1, 2, 3, 4)
WIDTH = 16
EPOCHS = 16
RATE = 0.3
#: Added to a subword's deviation: rare subwords count for less in short texts.
DAMP = 0.02
BATCH = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return gram_counts(data, offsets, SIZES, BUCKETS, True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    least: float  # below it a text is rejected

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, own: np.ndarray, classes: int, rate: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on embeddings and softmax, over the rows own; their product, and the bias."""
    embed = rng.normal(0, 0.05, (x.shape[1], WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.1, (WIDTH, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    with np.errstate(all="ignore"):  # a rate that is too high shows in the result
        for epoch in range(EPOCHS):
            step = rate * (1 - epoch / EPOCHS)
            order = own[rng.permutation(len(own))]
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                h = x[at] @ embed
                z = h @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                down = x[at].T @ (p @ soft.T)
                soft -= step * 10 * (h.T @ p)
                bias -= step * 10 * p.sum(0)
                embed -= step * (down + 1e-4 * embed)
        return embed @ soft, bias


def train(counts: np.ndarray, labels: list[str], seed: int = 7) -> Model:
    rng = np.random.RandomState(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    mean = x.mean(0)
    x -= mean
    scale = 1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + DAMP)  # subwords differ in frequency by orders; the embeddings absorb it
    x *= scale
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    rate = RATE
    while not np.isfinite((found := _descend(x, y, own, len(languages), rate, rng))[0]).all():
        rate /= 4
    embed_soft, bias = found
    weights = scale[:, None] * embed_soft
    model = Model(languages, weights.astype(np.float32), (bias - mean @ weights).astype(np.float32), 1.0, 0.0)
    test = held if len(held) else own
    best = np.inf
    for t in np.geomspace(0.25, 16, 25):
        model.temperature, old = float(t), model.temperature
        p = model.probabilities(counts[test])
        loss = -np.log(np.maximum(p[np.arange(len(test)), y[test]], 1e-9)).mean()
        model.temperature = float(t) if loss < best else old
        best = min(best, loss)
    p = model.probabilities(counts[test])
    right = p.argmax(1) == y[test]
    # half the least score of a text that was told right: what falls below looks like none of the languages
    model.least = float(p.max(1)[right].min() / 2) if right.any() else 0.0
    return model


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    ready(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).where("__id is not null and __text is not null and __lang is not null")
    sample = drawn(rows, "__id", F.col("__lang"), per_language)
    got = sample.mapInArrow(sparse_rows("__text", ["__id", "__lang"], _counts), f"__id {dict(rows.dtypes)['__id']}, __lang string, at binary, n binary").collect()
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["__id"], r["at"], r["n"]))
    if not got:
        return None
    labels, counts = [r["__lang"] for r in got], dense(got, BUCKETS)
    del got  # the counts are much memory already
    return train(counts, labels)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, bytes(data[offsets[k] : offsets[k + 1]]).decode()))
    return out


def _predict(model, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            data, offsets = texts(batch.column(text_col))
            known = has_letter(data, offsets) & (m is not None)
            score, which = np.zeros(len(known)), np.zeros(len(known), np.int64)
            if m is not None:
                for a, b, counts in row_counts(batch.column(text_col), _counts):
                    p = m.probabilities(counts)
                    which[a:b], score[a:b] = p.argmax(1), p.max(1)
            score[~known] = 0
            new = {
                "lang_pred": pa.array([m.languages[k] if ok else "und" for k, ok in zip(which, known, strict=True)], pa.string()),
                "score": pa.array(score),
                "rejected": pa.array(~known | (score < (m.least if m else 0))),
            }
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the calibrated probability) and rejected."""
    ready(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), text_col, schema.names), schema)
