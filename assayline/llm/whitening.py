"""Embedding whitening by a blockwise TSQR and a one-sided Jacobi SVD.

Each finite entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. Sums of the x are exact, so a centred
entry (n * x - S) / n is rounded once. Every partition compresses its centred rows, block by block, to one triangular factor R
(a QR of the factor so far on top of the next block); the factors of the partitions are combined in two more levels of QR, so
that no task gets more than a share of them, and one R of the vectors' width is left. Plane rotations make R's columns
orthogonal; the rotations, accumulated, are the components, and the columns' lengths over sqrt(n) the standard deviations,
accurate also for directions of little variance, since no covariance matrix is ever formed.

All remaining vectors are fitted on and whitened. Vectors that are null, empty, or hold null or non-finite entries (or
entries of 2**40 and more, beyond exact arithmetic) take no part, nor do those of another length than most (of lengths equally
frequent the smallest counts). A zero vector takes part like any other, rows that repeat each count, and a null vec_id keeps
its row. Components whose variance is zero up to rounding have no whitened values and are left out, so fewer than ``components`` may
come; one vector, or copies of one, give no rows, like an empty table. Of the two signs of a component the one is taken whose
largest entry is positive. A deviation beyond a long is null. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


@dataclass(frozen=True)
class WhiteningParameters:
    components: int = 8
    scale: int = 1024
    shift: int = 100_000
    #: Rows of a block of a QR, at least the vectors' width.
    block: int = 4_096
    #: Groups that the partitions' factors are combined in before the last step.
    groups: int = 64
    #: A component counts if its standard deviation is above this share of the largest.
    least: float = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: exact sums, components (a column each) by falling standard deviation, and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def kept(self, p: WhiteningParameters) -> int:
        """Components that have a variance, up to the number asked for."""
        return int((self.deviations[: p.components] > p.least * max(self.deviations[0], 1.0)).sum())


def whole_vectors(vectors: DataFrame, p: WhiteningParameters = WhiteningParameters()) -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the rows that take part, and their width."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40))
    v = v.where(F.coalesce(good, F.lit(False)))
    usual = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = usual[0]["d"] if usual else 0
    return v.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * p.scale) + p.shift).alias("x")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def sums(x: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and the exact sum of each dimension; pre-aggregated in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            n += b.num_rows
            total += _matrix(b.column("x"), d).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, d), pa.int32()), "s": pa.array([n, *total], pa.int64())})

    got = {r["at"]: int(r["s"]) for r in x.select("x").mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(d)], object)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """(n * x - S) / n, from exact numerators."""
    near, rest = np.array([divmod(int(v), n) for v in s], np.int64).T
    return ((x - near) * np.float64(n) - rest) / n


def _lists(m: np.ndarray) -> pa.ListArray:
    n, k = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(k)), pa.array(m.ravel()))


def _triangle(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")


def _rows(r: np.ndarray, part: int) -> pa.RecordBatch:
    d = r.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part, np.int32)), _lists(r)], ["part", "r"])


def factor(x: DataFrame, d: int, n: int, s: np.ndarray, p: WhiteningParameters) -> np.ndarray:
    """R of the centred rows: R'R is n times their covariance."""
    block, groups = max(p.block, d), p.groups

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for b in _blocks(batches, block):
            r = _triangle(r, centred(_matrix(b.column("x"), d), n, s))
        if r is not None:
            yield _rows(r, TaskContext.get().partitionId() % groups)

    def combine(table: pa.Table) -> pa.Table:
        r = None
        for b in _blocks(iter(table.to_batches()), block):
            r = _triangle(r, np.asarray(b.column("r").flatten()).reshape(-1, d))
        return pa.Table.from_batches([_rows(r, 0)])

    kind = "part int, r array<double>"
    parts = x.select("x").mapInArrow(compress, kind).groupBy("part").applyInArrow(combine, kind)
    last = parts.groupBy("part").applyInArrow(combine, kind)
    return np.array([row["r"] for row in last.collect()]).reshape(-1, d)  # at most d rows


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(V, lengths): rotations V, accumulated, that make the columns of r V orthogonal, and their lengths, falling.

    The pairs of a sweep run in rounds of disjoint columns (a round-robin), so a round is one vectorised step.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    order = np.arange(d + d % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            i, j = order[: len(order) // 2], order[::-1][: len(order) // 2]
            ok = (i < d) & (j < d)
            i, j = i[ok], j[ok]
            x, y = a[:, i], a[:, j]
            p, q, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(p * q)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > 1e-16
            i, j, p, q, c = i[turn], j[turn], p[turn], q[turn], c[turn]
            zeta = (q - p) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            for m in (a, v):
                x, y = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = cos * x - sin * y, sin * x + cos * y
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if worst < 4e-16 * max(d, 4):
            break
    lengths = np.sqrt((a * a).sum(0))
    fall = np.argsort(-lengths, kind="stable")
    v = v[:, fall]
    v = v / np.sqrt((v * v).sum(0))
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(d)] < 0, -1.0, 1.0), lengths[fall]


def fit(x: DataFrame, d: int, p: WhiteningParameters = WhiteningParameters()) -> Whitening | None:
    """The whitening of the rows of ``whole_vectors``; None without a row."""
    n, s = sums(x, d) if d else (0, np.zeros(0, object))
    if not n:
        return None
    components, lengths = jacobi(factor(x, d, n, s, p))
    return Whitening(n, s, components, lengths / np.sqrt(n), float((lengths**2).sum() / n))


def whitened(x: DataFrame, w: Whitening, p: WhiteningParameters = WhiteningParameters()) -> DataFrame:
    """(vec_id, deviation, w): the exact squared deviation, and the projections on the leading components in units of their
    standard deviations."""
    d, k = len(w.sums), w.kept(p)
    to = w.components[:, :k] / w.deviations[:k]
    near, rest = np.array([divmod(int(v), w.n) for v in w.sums], np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, p.block):
            m = _matrix(b.column("x"), d)
            small = m - near
            if (int(np.abs(small).max(initial=0)) + 1) ** 2 * w.n**2 * d < 2**63:
                apart = small * w.n - rest
                exact = (apart * apart).sum(axis=1).tolist()
            else:  # whole numbers of any size
                apart = small.astype(object) * w.n - rest.astype(object)
                exact = [e if e < 2**63 else None for e in (apart * apart).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(exact, pa.int64()), _lists(centred(m, w.n, w.sums) @ to)], ["vec_id", "deviation", "w"])

    return x.mapInArrow(run, "vec_id long, deviation long, w array<double>")


def report(vectors: DataFrame, p: WhiteningParameters = WhiteningParameters()) -> DataFrame:
    """A row for each vector and component, with how far the whitened values' covariance is from the identity."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x, d = whole_vectors(vectors, p)
    w = fit(x, d, p)
    k = 0 if w is None else w.kept(p)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = stored(whitened(x, w, p))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.element_at(F.array(*[F.lit(float(v)) for v in w.deviations[:k] ** 2 / w.trace]), F.col("component"))
    long = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return long.select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
