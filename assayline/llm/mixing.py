"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A block is one pass of one document. Each source owes an exact number of words, so an exact number of blocks; a tree over
the output shards splits every node's block quotas between its halves by a multivariate hypergeometric draw, and each
shard takes its own disjoint run of the source's permuted blocks and orders them locally by a hash.

Null or empty texts have size 0 and are taken for 0 words. A null source is a source of its own, the last. Repeated rows
are separate documents with equal keys; ties in the permutation fall to doc_id, then size. An empty table gives no rows.
One row of sums for each source goes to the driver, which makes the tree, and nothing else does; there is no limit on sources.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

WEIGHTS = (5, 2, 1)

#: Rows of a table of sources that is broadcast, at most.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class MixParameters:
    weights: tuple[int, ...] = WEIGHTS
    #: No source gives more than this many times its words.
    most_epochs: int = 3
    shards: int = 16
    seed: int = 17


def text_size(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def order_key(doc_id: Column | str, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))).cast("binary")), 1, 16)


def targets(sizes: list[tuple[str | None, int]], p: MixParameters = MixParameters()) -> dict[str | None, float]:
    """Shares of all words by weight; what a source can't give is shared anew among the others."""
    total = sum(s for _, s in sizes)
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = sorted(((p.most_epochs * s / p.weights[i % len(p.weights)], i, p.weights[i % len(p.weights)], p.most_epochs * s, name) for i, (name, s) in enumerate(ranked)), key=lambda x: x[:2])
    out, capped, weight = {}, 0, sum(x[2] for x in rows)
    level = None
    for ratio, _, w, cap, name in rows:
        if level is None and ratio >= (total - capped) / weight:
            level = (total - capped) / weight
        out[name] = float(cap) if level is None else min(float(cap), level * w)
        capped, weight = capped + cap, weight - w
    return out


#: numpy draws from fewer blocks than this; LARGE is where the inversion below takes over.
LARGE = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, want: int, large: int = LARGE) -> int:
    """How many of ``want`` blocks drawn without replacement are good.

    Beyond numpy's range by inversion over the exact masses, from the mode outwards by their ratios; what lies further than
    twelve standard deviations has less mass than a double resolves.
    """
    if good == 0 or bad == 0 or want == 0:
        return want if bad == 0 else 0
    total = good + bad
    if total < large:
        return int(rng.hypergeometric(good, bad, want))
    lo, hi = max(0, want - bad), min(good, want)
    mode = min(hi, max(lo, (want + 1) * (good + 1) // (total + 2)))
    spread = 12 * (int(np.sqrt(want * (good / total) * (bad / total) * ((total - want) / max(total - 1, 1)))) + 2)
    up = np.arange(mode, min(hi, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(lo, mode - spread), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (want - up) / ((up + 1) * (bad - want + up + 1)))
    below = np.cumprod(down * (bad - want + down) / ((good - down + 1) * (want - down + 1)))
    mass = np.cumsum(np.concatenate((below[::-1], [1.0], above)))
    return mode - len(below) + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(mass) - 1))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) that each shard (row) gets: the leaves of the splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid, total = (lo + hi) // 2, int(left.sum())
        rng = np.random.default_rng([seed, lo, hi])
        want, first = total * (mid - lo) // (hi - lo), np.zeros_like(left)
        for i, n in enumerate(left):
            rest = int(left[i:].sum())
            if want == 0 or rest == 0:
                break
            k = hypergeometric(rng, int(n), rest - int(n), want)
            first[i] = k
            want -= k
        node(first, lo, mid)
        node(left - first, mid, hi)

    if quotas:
        node(np.array(quotas, np.int64), 0, shards)
    return out


def ranked(docs: DataFrame, p: MixParameters) -> tuple[DataFrame, list]:
    """Compact rows (doc_id, source, size, key, bucket, part) without texts, and the sums of each source.

    ``part`` is the finest group that a window works on: a source's permutation cut into 4096 runs, so a source that
    holds a third of the corpus is no larger a task than any other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size().alias("size"), order_key("doc_id", p.seed).alias("key"))
    rows = stored(rows.withColumn("bucket", F.substring("key", 1, 3)))
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    return rows, sums


def with_cuts(rows: DataFrame, sums: list, p: MixParameters) -> DataFrame:
    """Adds to each row its source's target and its place in the source's permutation: ``before`` words, ``rank`` blocks, ``full`` of them with words."""
    spark: SparkSession = rows.sparkSession
    goal = targets([(s.source, s.words) for s in sums], p)
    owed = [(s.source, s.words, s.n, goal[s.source], int(np.floor(goal[s.source] + 0.5))) for s in sums]
    dim = spark.createDataFrame(owed, "source string, source_size long, source_docs long, target double, owed long")
    dim = dim.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("owed div source_size")).otherwise(0)).withColumn("left_over", F.col("owed") - F.col("epochs") * F.col("source_size"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    has_words = (F.col("size") > 0).cast("long")
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.sum(has_words).alias("f"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("w").over(up_to), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(up_to), F.lit(0)).alias("f0"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("w1"), F.count(F.lit(1)).over(inside).alias("n1"), F.coalesce(F.sum(has_words).over(inside), F.lit(0)).alias("f1"))
    placed = local.alias("a").join(offsets.alias("o"), same("a", "o") & (F.col("a.bucket") == F.col("o.bucket"))).select("a.doc_id", "a.source", "a.size", "a.key", (F.col("w0") + F.col("w1")).alias("before"), (F.col("n0") + F.col("n1")).alias("rank"), (F.col("f0") + F.col("f1")).alias("full"))
    out = placed.alias("p").join(_dim(dim, len(owed)).alias("d"), same("p", "d")).drop(F.col("d.source"))
    extra = F.least(F.greatest(F.col("left_over") - F.col("before"), F.lit(0)), F.col("size"))
    return out.withColumn("extra", extra).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def dealt(placed: DataFrame, p: MixParameters) -> list[tuple]:
    """Each source's sums, and where its permuted blocks end in each shard, by the splitting tree."""
    block = F.col("epochs") + (F.col("extra") > 0).cast("long")
    quota = placed.groupBy("source").agg(F.sum(block).alias("blocks"), F.max("epochs").alias("epochs"), F.max("source_docs").alias("docs")).collect()
    quota.sort(key=lambda x: (x.source is None, x.source or ""))
    leaves = split_quotas([q.blocks for q in quota], p.shards, p.seed)
    return [(q, [int(x) for x in np.cumsum(leaves[:, i])]) for i, q in enumerate(quota)]


def _dim(sources: DataFrame, rows: int) -> DataFrame:
    """A table of few rows a source, broadcast while it is small by count."""
    return F.broadcast(sources) if rows <= BROADCAST_ROWS else sources


def mix(docs: DataFrame, p: MixParameters = MixParameters()) -> DataFrame:
    """One row per document: ``blocks``, the passes that shards draw of it with their words, shard and local order, and
    ``taken``, the words of all of them."""
    rows, sums = ranked(docs, p)
    placed = stored(with_cuts(rows, sums, p))
    ends = [(q.source, e) for q, e in dealt(placed, p)]
    ends = _dim(placed.sparkSession.createDataFrame(ends, "source string, ends array<long>"), len(ends))
    copies = F.transform(F.sequence(F.lit(0), F.col("epochs").cast("int")), lambda c: F.struct(c.alias("pass"), F.when(c < F.col("epochs"), F.col("size")).otherwise(F.col("extra")).alias("words"), (c * F.col("source_docs") + F.when(c < F.col("epochs"), F.col("rank")).otherwise(F.col("full"))).alias("at")))
    # the last pass is there only for the documents that the left-over words reach, and counts none without words
    copies = F.filter(copies, lambda x: (x["pass"] < F.col("epochs")) | (F.col("extra") > 0))
    blocks = F.transform(copies, lambda x: F.struct(F.size(F.filter("ends", lambda e: e <= x["at"])).alias("shard"), F.xxhash64(F.lit(p.seed), "doc_id", x["pass"]).alias("place"), x["words"].alias("words")))
    return placed.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source"))).select("p.doc_id", "p.source", "size", "source_size", "target", blocks.alias("blocks")).withColumn("taken", F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["words"]))


def dealt_rows(docs: DataFrame, p: MixParameters = MixParameters()) -> DataFrame:
    """(row, shard, place): the rows of ``docs``, as structs, as often as the mix takes them, in whole passes (the last one if
    at least half of it is taken), each with its shard by the splitting tree and its place in that shard's local order.

    Texts aren't joined with their ranks: where a shard's run of a source's permuted blocks begins is one (pass, key, doc_id,
    size), which every row of the source is compared with. Rows alike in all of these fall on one side of it.
    """
    spark, (rows, sums) = docs.sparkSession, ranked(docs, p)
    placed = stored(with_cuts(rows, sums, p))
    begins = []
    for q, ends in dealt(placed, p):
        whole = q.epochs * q.docs
        for e in (0, *ends[:-1]):
            if e < q.blocks:
                begins.append((q.source, e // q.docs if e < whole else q.epochs, e % q.docs if e < whole else e - whole, e >= whole))
    edge = _dim(spark.createDataFrame(begins, "source string, pass long, pos long, last boolean"), len(begins))
    own = ("source", "key", "doc_id", "size")
    at = placed.select(*own, F.col("rank").alias("pos"), F.lit(False).alias("last")).union(placed.where("extra > 0").select(*own, F.col("full").alias("pos"), F.lit(True).alias("last")))
    met = at.alias("a").join(edge.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source")) & (F.col("a.pos") == F.col("e.pos")) & (F.col("a.last") == F.col("e.last")))
    cuts = met.select("a.source", F.struct(F.col("e.pass").alias("pass"), F.col("a.key").alias("key"), F.col("a.doc_id").alias("id"), F.col("a.size").alias("words")).alias("cut")).groupBy("source").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    last = F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), F.struct("key", F.col("doc_id").alias("id"), F.col("size").alias("words")))
    dim = placed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(last).alias("upto"))
    dim = _dim(stored(dim.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select("d.source", "epochs", "upto", "cuts")), len(sums))
    mine = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), order_key("doc_id", p.seed).alias("key"), F.col("doc_id").cast("long").alias("id"), text_size().alias("words"))
    out = mine.alias("x").join(dim.alias("c"), F.col("x.source").eqNullSafe(F.col("c.source")))
    once_more = (F.col("words") > 0) & F.col("upto").isNotNull() & (F.struct("key", "id", "words") <= F.col("upto"))
    times = F.col("epochs") + F.when(once_more, 1).otherwise(0)
    out = out.select("row", "key", "id", "words", "cuts", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))).alias("pass"))
    # a source's first block begins the first shard that has any; the begin at 0 stands for the start itself
    shard = F.size(F.filter("cuts", lambda e: e <= F.struct("pass", "key", "id", "words"))) - 1
    return out.select("row", shard.alias("shard"), F.xxhash64(F.lit(p.seed), "id", F.col("pass").cast("int")).alias("place"))


def mixed_rows(docs: DataFrame, p: MixParameters = MixParameters()) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, shard by shard, in each shard's local order.

    A shard is laid out in up to 256 parts by place, so none is one task; parts that many alike rows make large are split.
    """
    laid = dealt_rows(docs, p).withColumn("part", F.pmod("place", F.lit(256)))
    return laid.hint("rebalance", "shard", "part").sortWithinPartitions("shard", "part", "place").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), l AS (SELECT coalesce((SELECT level FROM r WHERE cap / w >= level ORDER BY cap / w, i LIMIT 1), 0) AS level
), t AS (
  SELECT r.source, r.source_size, least(r.cap::DOUBLE, l.level * r.w) AS target,
         floor(least(r.cap::DOUBLE, l.level * r.w) + 0.5)::BIGINT AS owed
  FROM r, l
), c AS (
  SELECT d.*, t.source_size, t.target, t.owed, CASE WHEN t.source_size > 0 THEN t.owed // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (epochs * size + least(greatest(owed - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM c
"""
