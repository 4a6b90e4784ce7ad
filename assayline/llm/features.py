"""Hashed n-gram features, shared by the two classifiers, and the bounded sample of labelled rows that they learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, text_slices
from .kernels import Words, mix

_U = np.uint64


def characters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The text that each code point belongs to, and its UTF-8 bytes as one number; a blank ends each text."""
    at = np.flatnonzero((w.buf & 0xC0) != 0x80)
    wide = np.concatenate((w.buf, np.zeros(3, np.uint8)))
    symbols, more = w.buf[at].astype(np.uint64), np.ones(len(at), bool)
    for j in (1, 2, 3):
        more &= (wide[at + j] & 0xC0) == 0x80
        symbols |= np.where(more, wide[at + j], 0).astype(np.uint64) << _U(8 * j)
    return np.searchsorted(w.bounds, at, side="right") - 1, symbols


class Hasher:
    """Word n-grams and, where asked for, n-grams of code points of each text, hashed into ``2 ** bits`` places each.

    No n-gram reaches into another text, so a text's features don't depend on what it is batched with.

    With ``repeats``, each word 3-gram that came before in its text also counts towards one place of its own.
    Every occurrence weighs 1 / sqrt(occurrences of its kind in the text).
    """

    def __init__(self, bits: int = 18, words: tuple[int, ...] = (1, 2), chars: tuple[int, ...] = (), repeats: bool = False):
        self.bits, self.words, self.chars, self.repeats = bits, tuple(words), tuple(chars), repeats

    @property
    def size(self) -> int:
        return (1 + bool(self.chars)) << self.bits

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and value of each feature, rows in no order."""
        w = Words(texts)
        n, rows, places = len(texts), [[], []], [[], []]
        for k in self.words:
            at, h = w.grams(k)
            rows[0].append(w.doc[at])
            places[0].append((h >> _U(64 - self.bits)).astype(np.int64))
        if self.repeats:
            at, h = w.grams(3)
            key = mix(h ^ w.doc[at].astype(np.uint64))
            order = np.argsort(key, kind="stable")
            again = w.doc[at[order[1:][key[order[1:]] == key[order[:-1]]]]]
            rows[0].append(again)
            places[0].append(np.zeros(len(again), np.int64))
        if self.chars:
            of, symbols = characters(w)
            for k in self.chars:
                m = max(0, len(symbols) - k + 1)
                own = np.flatnonzero(of[:m] == of[k - 1 :]) if m else np.zeros(0, np.int64)
                h = np.full(len(own), k, np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(k):
                        h = mix(h * _U(257) + symbols[own + j])
                rows[1].append(of[own])
                places[1].append((h >> _U(64 - self.bits)).astype(np.int64) + (1 << self.bits))
        out = []
        for r, p in zip(rows, places, strict=True):
            if r:
                r, p = np.concatenate(r), np.concatenate(p)
                share = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=n), 1))
                out.append((r, p, share[r]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def margins(self, texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
        """Sparse dot products with the weights."""
        r, p, v = self(texts)
        return np.bincount(r, weights=weights[p] * v, minlength=len(texts)) + bias


def learn_from(docs: DataFrame, labels: DataFrame, label: str, hasher: Hasher, most: int, keep: Column | None = None):
    """Features of at most ``most`` labelled rows, the same ones on every run: those whose ids hash lowest.

    Of rows that share a doc_id one is learnt from, the text of the smallest hash. The bound is the only one: features are hashed on the executors, and the driver gets ``most`` sparse rows.
    Returns (labels, list of (places, values) of each row); a row's places are distinct.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if keep is not None:
        picked = picked.where(keep)
    # one row for each id that has both a label and a text; a text's hash stands for it until the bound has chosen
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"))
    both = picked.groupBy("doc_id").agg(F.max("y").alias("y")).join(texts.groupBy("doc_id").agg(F.min("mark").alias("mark")), "doc_id")
    picked = both.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(picked.withColumn("id", F.col("doc_id")).drop("doc_id")), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("mark"))).groupBy("doc_id").agg(F.first("text").alias("text"), F.max("y").alias("y"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            r, p, v = hasher(raw_texts(b.column("text")))
            key, back = np.unique(r * hasher.size + p, return_inverse=True)
            v = np.bincount(back, weights=v, minlength=len(key)).astype(np.float32)
            r, p = key // hasher.size, (key % hasher.size).astype(np.int32)
            cut = np.searchsorted(r, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "places": pa.array([p[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()), "values": pa.array([v[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())})

    got = rows.mapInArrow(hashed, "doc_id long, y int, places binary, values binary").collect()
    got = sorted(got, key=lambda x: (int(mix(np.array([x.doc_id & 0xFFFFFFFF], np.uint64))[0]), x.doc_id, bytes(x.places)))
    return np.array([x.y for x in got], np.float64), [(np.frombuffer(x.places, np.int32), np.frombuffer(x["values"], np.float32)) for x in got]
