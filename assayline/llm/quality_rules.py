"""Quality rules: surface counts, and a calibrated logistic regression over hashed word and character n-grams.

Rows with a null or empty text have no words, so they fail the base rules. Repeated rows are judged alike; a null doc_id
is carried along. An empty table gives no rows. Without labelled rows of both classes the model abstains: every text that
passes the base rules is kept. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import only, raw_texts, text_slices
from .features import Hasher, learn_from
from .kernels import SPACE, Words, mix, per_text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RuleParameters:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Kept if the calibrated probability of good quality is at least this.
    threshold: float = 0.3
    #: Labelled rows that the model learns from, at most.
    sample_rows: int = 2000
    #: Of these, the share kept aside for calibration.
    calibration_share: float = 0.25
    bits: int = 17
    epochs: int = 40
    rate: float = 0.5
    l2: float = 1e-4


class Model:
    """Weights over hashed n-grams and the two numbers of Platt's scaling."""

    def __init__(self, hasher: Hasher, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.hasher, self.weights, self.bias, self.slope, self.shift = hasher, weights, bias, slope, shift

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = self.slope * self.hasher.margins(texts, self.weights, self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit(y: np.ndarray, rows: list, size: int, p: RuleParameters) -> tuple[np.ndarray, float]:
    """Full-batch AdaGrad on the logistic loss, classes weighted alike."""
    cut = np.cumsum([0, *(len(a) for a, _ in rows)])
    places, values = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(cut))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, g2, b2 = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(p.epochs):
        z = np.bincount(row, weights=w[places] * values, minlength=len(rows)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g, gb = np.bincount(places, weights=values * e[row], minlength=size) + p.l2 * w * 1e-2, e.sum()
        g2 += g * g
        b2 += gb * gb
        w -= p.rate * g / np.sqrt(g2)
        b -= p.rate * gb / np.sqrt(b2)
    return w, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A probability from a margin: Newton's method with halved steps, on Platt's smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    loss = lambda c: float((np.logaddexp(0, x @ c) - t * (x @ c)).sum())
    c = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - t))
        size, now = 1.0, loss(c)
        while size > 1e-6 and loss(c - size * step) > now:
            size /= 2
        c = c - size * step
        if abs(step).max() * size < 1e-8:
            break
    return max(c[0], 1e-3) / scale, c[1]


def train(docs: DataFrame, labels: DataFrame, p: RuleParameters = RuleParameters(), keep: Column | None = None) -> Model | None:
    """None if the labels don't hold both classes."""
    hasher = Hasher(p.bits, words=(1, 2), chars=(3, 4))
    y, rows = learn_from(only(docs), labels, "quality", hasher, p.sample_rows, keep)
    if not 0 < y.sum() < len(y):
        return None
    aside = np.arange(len(y)) % max(2, round(1 / p.calibration_share)) == 0
    part = lambda m: (y[m], [r for r, x in zip(rows, m, strict=True) if x])
    fit, cal = part(~aside), part(aside)
    if not all(0 < x.sum() < len(x) for x in (fit[0], cal[0])):
        fit = cal = (y, rows)
    w, b = _fit(*fit, hasher.size, p)
    z = np.array([w[a] @ v for a, v in cal[1]]) + b
    slope, shift = _platt(z, cal[0])
    return Model(hasher, w.astype(np.float32), b, slope, shift)


def surface(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts that the base rules look at."""
    w, n = Words(texts), len(texts)
    owner = np.repeat(np.arange(n), np.diff(w.bounds))
    lead = ((w.buf & 0xC0) != 0x80) & ~SPACE[w.buf]
    # separators between texts are white space, and no symbol is
    again = np.zeros(len(w.hashes), bool)
    at, h = w.grams(3)
    if len(at):
        key = mix(h ^ mix(w.doc[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            again[at[twice] + k] = True
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    count = lambda mask, of: np.bincount(of[mask], minlength=n).astype(np.int64)
    return {"n_words": w.counts().astype(np.int64), "word_chars": count(lead, owner), "n_symbols": count(SYMBOLS[w.buf], owner), "n_dup_lines": dup, "n_repeat_words": count(again, w.doc)}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def apply(docs: DataFrame, model: Model | None, p: RuleParameters = RuleParameters()) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts = raw_texts(b.column("text"))
            s = surface(texts)
            failed = (s["n_words"] < p.min_words) | (100 * s["n_repeat_words"] > p.max_repeat_percent * s["n_words"])
            good = np.full(len(texts), np.nan) if sent.value is None else sent.value.probability(texts)
            kept = ~failed & (np.isnan(good) | (good >= p.threshold))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{k: pa.array(v) for k, v in s.items()}, "base_failed": pa.array(failed), "kept": pa.array(kept), "probability": pa.array(good, mask=np.isnan(good))})

    return only(docs).mapInArrow(judged, SCHEMA)
