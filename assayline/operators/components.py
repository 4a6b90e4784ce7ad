"""Connected components: union-find within tasks, then alternating large-star and small-star steps (distributed union-find)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Edges that one task contracts, about; that many need no rounds between tasks.
TASK_EDGES = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): each node of a partition's edges with the smallest node of its component there; that one is left out."""
    schema = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in edges.dtypes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array(map(find, part), schema.field(1).type)], schema=schema)

    return edges.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in edges.dtypes))


def connected(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node on an edge (a, b), of longs or strings; root is the component's smallest node.

    Tasks of about ``task_edges`` edges contract what they hold to one edge for each node. Where that took more than one task,
    steps follow until the edges settle, however many that takes: minima are pre-aggregated before each shuffle, and a
    node's links are never gathered into one row. Each round is written to the shared folder, so a lost executor costs one
    round at most, and the round before it is deleted. Null ends and loops make no edge.
    """
    given = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    parts = -(-given.count() // task_edges)
    now = stored(contracted(given.coalesce(max(1, parts))))
    dropped(given)
    before = None
    while parts > 1:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        after = stored(small)
        dropped(now)
        now = after
        # order-free fingerprint of the edge set
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
