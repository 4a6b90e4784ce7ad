"""Quality classifier: hashed word n-grams, follow-the-regularised-leader updates, scores as sparse dot products.

A null or empty text has no n-grams and gets the score of the bias alone. Repeated rows score alike; a null doc_id is
never held out and never learnt from. Without labelled rows of both classes every score is the share of label 1 seen, or
0.5 where none was. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, raw_texts, text_slices
from .features import Hasher, learn_from


@dataclass(frozen=True)
class FtrlParameters:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 0.1
    epochs: int = 4
    bits: int = 18
    #: Labelled rows that the model learns from, at most.
    sample_rows: int = 8000
    threshold: float = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the ids that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ftrl(y: np.ndarray, rows: list, size: int, p: FtrlParameters) -> tuple[np.ndarray, float]:
    """FTRL-proximal, one row at a time with a learning rate for each weight; the bias is not regularised."""
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = 0.0, 0.0
    for _ in range(p.epochs):
        for label, (at, x) in zip(y, rows, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            e = 1 / (1 + np.exp(-min(35.0, max(-35.0, float(w @ x) + bias)))) - label
            g = e * x
            after = ni + g * g
            z[at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / p.alpha * w
            n[at] = after
            bias_n += e * e
            bias -= p.alpha * e / (p.beta + np.sqrt(bias_n))
    return np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)), bias


def train(docs: DataFrame, labels: DataFrame, p: FtrlParameters = FtrlParameters()) -> tuple[Hasher, np.ndarray, float]:
    hasher = Hasher(p.bits, words=(1, 2), repeats=True)
    y, rows = learn_from(only(docs), labels, "quality", hasher, p.sample_rows, ~held_out())
    if not 0 < y.sum() < len(y):
        share = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 0.5
        return hasher, np.zeros(hasher.size, np.float32), float(np.log(share / (1 - share)))
    w, b = ftrl(y, rows, hasher.size, p)
    return hasher, w.astype(np.float32), b


def scored(docs: DataFrame, model: tuple[Hasher, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weights, bias = sent.value
        for b in text_slices(batches):
            z = hasher.margins(raw_texts(b.column("text")), weights, bias)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))})

    return only(docs).mapInArrow(score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, p: FtrlParameters = FtrlParameters()) -> DataFrame:
    out = scored(docs, train(docs, labels, p))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, p: FtrlParameters = FtrlParameters()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weights, bias = sent.value
        for b in text_slices(batches):
            z = hasher.margins(raw_texts(b.column("text")), weights, bias)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))) >= p.threshold))

    return docs.mapInArrow(choose, docs.schema)
