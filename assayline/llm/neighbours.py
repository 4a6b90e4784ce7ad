"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; a cell is a pair of centroids. A query pops cells from a heap
by the sum of its two distances until it has met enough candidates, and the candidates' original vectors are reranked in
double precision. The codebooks are fitted on a bounded sample; every row is indexed. Heavy cells are cut into blocks of
bounded size by a hash of id and vector, so a vector or an id that a third of the rows share spreads over many tasks, and
each block answers every query that probes it with its nearest distinct ids.

Vectors that are null, zero, of another length than most, or with null or non-finite components take no part, nor do
null ids. Equal rows are indexed once. Rows that share a vec_id count as one neighbour, at the smallest of their distances. Ties go to the smaller
vec_id. With no valid vector there are no rows. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IndexParameters:
    #: Centroids of each half.
    centroids: int = 16
    #: Rows that the codebooks are fitted on, at most.
    sample_rows: int = 10_000
    rounds: int = 15
    #: A query stops once its cells hold this share of all rows, and more rows than it wants neighbours.
    share: float = 0.65
    neighbours: int = 10
    #: Rows of a block, at least; above, the table's size over ``blocks``.
    block_rows: int = 256
    blocks: int = 4096
    seed: int = 7


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        a = _squares(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        sums = np.stack([np.bincount(a, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
    """Non-empty cells in order of d1[i] + d2[j], until they hold ``want`` rows."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, got, out = d1[o1].tolist(), d2[o2].tolist(), 0, []
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(b) + int(o2[j])
        if n := int(sizes[cell]):
            got += n
            out.append(cell)
        for x in ((i + 1, j), (i, j + 1)):
            if x[0] < len(a) and x[1] < len(b) and x not in seen:
                seen.add(x)
                heapq.heappush(heap, (a[x[0]] + b[x[1]], *x))
    return out


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good: Column = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(good, F.lit(False)))
    usual = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (usual[0]["n"] if usual else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(vectors: DataFrame, is_query: Column, p: IndexParameters = IndexParameters()) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest rows found."""
    spark, rows = vectors.sparkSession, valid(vectors).distinct()
    out_schema = "query_id long, vec_id long, score double"
    sample = sorted(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample_rows).collect())
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r.v for r in sample])
    half, rng = (x.shape[1] + 1) // 2, np.random.default_rng(p.seed)
    books = _kmeans(x[:, :half], p.centroids, p.rounds, rng), _kmeans(x[:, half:], p.centroids, p.rounds, rng)
    n_cells = len(books[0]) * len(books[1])
    sent = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        for b in batches:
            m = _matrix(b.column("v"))
            cell = _squares(m[:, :half], one).argmin(1) * len(two) + _squares(m[:, half:], two).argmin(1) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": b.column("v"), "cell": pa.array(cell.astype(np.int32))})

    index = rows.mapInArrow(assign, "vec_id long, v array<double>, cell int")
    sizes = np.zeros(n_cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        sizes[r["cell"]] = r["count"]
    want = max(int(np.ceil(p.share * sizes.sum())), p.neighbours + 1)
    cuts = np.maximum(1, -(-sizes // max(p.block_rows, int(sizes.sum()) // p.blocks)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        for b in batches:
            m = _matrix(b.column("v"))
            if not len(m):
                continue
            d1, d2 = _squares(m[:, :half], one), _squares(m[:, half:], two)
            for i in range(len(m)):
                keys = [(c << 32) | s for c in traverse(d1[i], d2[i], sizes, want) for s in range(int(cuts[c]))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("vec_id").slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32))), b.column("v").slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32)))], ["block", "query_id", "q"])

    probes = rows.where(is_query).mapInArrow(probe, "block long, query_id long, q array<double>")
    cut = spark.createDataFrame([(i, int(x)) for i, x in enumerate(cuts) if x > 1], "cell int, parts long")  # at most centroids ** 2 rows
    blocks = F.coalesce("parts", F.lit(1).cast("long"))
    index = index.join(cut, "cell", "left").select(F.shiftleft(F.col("cell").cast("long"), 32).bitwiseOR(F.pmod(F.xxhash64("vec_id", "v"), blocks)).alias("block"), "vec_id", "v")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest rows of one block for each query that probes it."""
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, m = np.asarray(left.column("vec_id")), _matrix(left.column("v").combine_chunks())
        by_id = np.argsort(ids, kind="stable")
        ids, m = ids[by_id], m[by_id]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        queries, q = np.asarray(right.column("query_id")), _matrix(right.column("q").combine_chunks())
        out: list[tuple] = []
        norms = (m * m).sum(1)
        step = max(1, 4_000_000 // len(ids))
        for at in range(0, len(queries), step):
            near = norms[None] - 2 * q[at : at + step] @ m.T
            for i in range(len(near)):
                d = near[i]
                d[ids == queries[at + i]] = np.inf
                # the edge is the last place's distance over distinct ids; a margin far above rounding keeps every row that could be among the nearest
                if len(starts) > p.neighbours:
                    edge = np.partition(np.minimum.reduceat(d, starts) if len(starts) < len(d) else d, p.neighbours - 1)[p.neighbours - 1]
                    keep = np.flatnonzero(d <= edge + 1e-9 * (1 + abs(edge)))
                else:
                    keep = np.arange(len(d))
                keep = keep[np.isfinite(d[keep])]
                exact = np.sqrt(((m[keep] - q[at + i]) ** 2).sum(1))
                order = np.lexsort((ids[keep], exact))
                first, seen = [], set()
                for j in order:  # rows of one vec_id count once
                    if ids[keep[j]] not in seen:
                        seen.add(ids[keep[j]])
                        first.append(j)
                        if len(first) == p.neighbours:
                            break
                out.append((np.full(len(first), queries[at + i]), ids[keep][first], exact[first]))
        cat = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    found = index.groupBy("block").cogroup(probes.groupBy("block")).applyInArrow(rerank, out_schema)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= p.neighbours)


def every_hundredth(vectors: DataFrame, p: IndexParameters = IndexParameters()) -> DataFrame:
    return search(vectors, F.col("vec_id") % 100 == 0, p)
