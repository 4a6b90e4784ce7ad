"""MinHash near-dedup of documents by tensored banding, with verification on full sets.

A document's set holds its distinct word shingles. Of each set ``collections`` small hashes are made, each from ``rows``
minima, and every pair of collections forms the key of one table: m collections give m * (m - 1) / 2 tables of 2 * rows
minima each, from m * rows minima instead of m * (m - 1) * rows, about a square root of them. A pair of sets meets in a table as
soon as two collections agree. With similarity s that fails with probability
(1 - q) ** m + m * q * (1 - q) ** (m - 1), where q = s ** rows: 0.00018 at s = 0.80 with the 16 collections of 3 rows used
here, 0.000003 at 0.87. What meets is verified by the exact intersection of whole sets (``linking``): no key is expanded into
all pairs of its holders, none is capped, and groups of near copies cost links in proportion to their size.

Equal sets are one node from the start; a node is a 64-bit fingerprint whose uniqueness is checked with 64 further bits, and
where two sets share one, all are made again with another salt. An empty or null text has the empty set, which links with
nothing. A text of fewer words than a shingle has one shingle, the whole sequence. Every row shows its own component, so
different texts that share a doc_id are nodes of their own, and rows that repeat are one. A row with a null doc_id links like
any other; its component is the smallest doc_id among the linked rows, null if none has one, and such a row is kept only if
its component is null too and no equal or linked row comes before it by a hash of the text: ``representatives`` keeps one row. An empty
table gives no rows. Columns other than doc_id and text are ignored by ``components`` and carried along by ``representatives``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, freed, stored
from . import linking
from .common import only, raw_texts, text_slices, width
from .jaccard_join import bodies, keyed, shingles
from .kernels import mix

_U = np.uint64


@dataclass(frozen=True)
class NearParameters:
    words: int = 2
    #: Similarity of a link, in percent: 100 * intersection >= percent * union.
    percent: int = 80
    #: Collections, and minima of each.
    collections: int = 16
    rows: int = 3
    seed: int = 11
    #: Documents (hashed choice) in which frequent keys are looked for; they only steer where holders go, never the result.
    sample_docs: int = 4_000
    link: linking.LinkParameters = field(default_factory=lambda: linking.LinkParameters(percent=80, offers=16))

    @property
    def tables(self) -> int:
        return self.collections * (self.collections - 1) // 2


def collections(sets: list[np.ndarray], p: NearParameters) -> np.ndarray:
    """The collections' hashes of some sets that aren't empty: (sets, collections)."""
    rng = np.random.default_rng(p.seed)
    factors = rng.integers(0, 1 << 63, (p.collections, p.rows), dtype=np.uint64) * _U(2) + _U(1)
    tokens = mix(np.concatenate(sets))
    start = np.cumsum([0, *map(len, sets[:-1])])
    out, w = np.empty((len(sets), p.collections), np.uint64), np.empty_like(tokens)
    for c in range(p.collections):
        h = np.full(len(sets), c + 1, np.uint64)
        for r in range(p.rows):
            with np.errstate(over="ignore"):
                np.multiply(tokens, factors[c, r], out=w)
                h = mix(h * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(w, start))
        out[:, c] = h
    return out


def table_keys(sets: list[np.ndarray], p: NearParameters) -> np.ndarray:
    """A key for each set and table, formed from a pair of collections: (sets, tables)."""
    own = collections(sets, p)
    i, j = np.triu_indices(p.collections, 1)
    with np.errstate(over="ignore"):
        return mix(own[:, i] * _U(0xA0761D6478BD642F) + own[:, j] + (i * p.collections + j).astype(np.uint64) * _U(0xE7037ED1A0B428DB))


def identities(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    """A set's node and the bits that check it."""
    x = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=salt.to_bytes(4, "little")).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def sets(docs: DataFrame, p: NearParameters, salt: int = 0) -> DataFrame:
    """(rid, doc_id, n, fp, proof, bitmap) of each row; fp, proof and the parity bitmap are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = shingles(raw_texts(b.column("text")), p.words)
            ids = [identities(x, salt) if len(x) else (None, None) for x in found]
            yield pa.RecordBatch.from_pydict({"rid": b.column("rid"), "doc_id": b.column("doc_id"), "n": pa.array([len(x) for x in found], pa.int64()), "fp": pa.array([x[0] for x in ids], pa.int64()), "proof": pa.array([x[1] for x in ids], pa.int64()), "bitmap": linking.bitmaps(found, p.link.bits)})

    return keyed(docs).mapInArrow(run, "rid long, doc_id long, n long, fp long, proof long, bitmap binary")


def nodes_of(docs: DataFrame, p: NearParameters) -> tuple[DataFrame, DataFrame, int]:
    """The rows of ``sets``, (fp, rid) of each distinct set, and the salt with which no two sets share a node."""
    for salt in count():
        every = stored(sets(docs, p, salt))
        nodes = stored(every.where("fp IS NOT NULL").groupBy("fp").agg(F.min("rid").alias("rid"), F.min("proof").alias("least"), F.max("proof").alias("most")))
        if nodes.where("least <> most").isEmpty():
            return every, nodes.select("fp", "rid"), salt
        dropped(every, nodes)
    raise AssertionError("unreachable")


def signatures(docs: DataFrame, p: NearParameters, salt: int, buckets: int, hot: linking.Hot) -> DataFrame:
    """(bucket, packed): table keys and their sets' nodes, dealt by key; equal sets of a task once."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sig: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for b in text_slices(batches):
            fresh: dict[int, np.ndarray] = {}
            for x in shingles(raw_texts(b.column("text")), p.words):
                if len(x) and (f := identities(x, salt)[0]) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(f)
                    fresh[f] = x
            if fresh:
                keys = table_keys(list(fresh.values()), p)
                sig.append(keys.ravel())
                ids.append(np.repeat(np.array(list(fresh), np.int64), p.tables))
                sizes.append(np.repeat(linking.steps(np.fromiter(map(len, fresh.values()), np.int64, len(fresh))), p.tables))
                held += keys.size
            if held > linking.PORTION:
                packed = linking.pack(sig, ids, sizes, buckets, sent.value)
                sig, ids, sizes, held = [], [], [], 0
                yield packed
        if held:
            yield linking.pack(sig, ids, sizes, buckets, sent.value)

    return only(docs).mapInArrow(run, "bucket int, packed binary")


def _sampled(docs: DataFrame, every: int, p: NearParameters) -> DataFrame:
    """(s): the table keys of sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            if found := [x for x in shingles(raw_texts(b.column("text")), p.words) if len(x)]:
                yield pa.RecordBatch.from_pydict({"s": pa.array(table_keys(found, p).ravel().view(np.int64))})

    return keyed(docs).where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("text").mapInArrow(run, "s long")


def _labelled(docs: DataFrame, p: NearParameters) -> DataFrame:
    """(rid, doc_id, n, component, root) of each row; root is null for the empty set."""
    spark = docs.sparkSession
    every, nodes, salt = nodes_of(docs, p)
    n = nodes.count()
    one_in = max(1, n // p.sample_docs)
    hot = linking.hot(_sampled(docs, one_in, p), one_in, p.link) if n > p.link.shard_holders else linking.NO_HOT
    buckets = int(max(width(spark), n * p.tables // p.link.task_signatures + 1))
    found = stored(linking.runs(signatures(docs, p, salt, buckets, hot), hot, p.link))
    freed(spark)
    sketches = linking.by_node(linking.marked(every.where("fp IS NOT NULL").select("fp", "n", "bitmap"), linking.candidates(found, p.link)), n * 8, p.link)
    freed(spark)
    labels = linking.linked(found, sketches, lambda fps: bodies(docs, nodes, fps, lambda x: identities(x, salt)[0], p), lambda x: shingles(x, p.words), p.link)
    rooted = every.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component"))
    return rooted.join(least, "root", "left")


def components(docs: DataFrame, p: NearParameters = NearParameters()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    component = F.coalesce("component", "doc_id")
    return _labelled(docs, p).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, p: NearParameters = NearParameters()) -> DataFrame:
    """One row of ``docs`` for each component, of the smallest doc_id (a null one is the last); rows without a word are all
    kept, and so are all that repeat the kept row's doc_id and text."""
    rows = stored(_labelled(docs, p).where("root IS NOT NULL").groupBy("rid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("at"), F.min("root").alias("root")))
    keep = rows.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.rid").alias("rid"))
    go = rows.join(keep, "rid", "left_anti").select("rid")
    # a reference bound to one side keeps columns of the same name apart
    return docs.join(go, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) == go["rid"], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                                    WHEN len(ws) = 1 THEN ['short ' || ws[1]] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, coalesce(len(sh), 0) AS n FROM s
), t AS (SELECT s.doc_id, n.n, unnest(sh) AS x FROM s JOIN n USING (doc_id)
), f AS (  -- a linked pair shares one of the rarest tokens of each set: all but 80 % of it and one more
  SELECT t.doc_id, t.n, t.x, row_number() OVER (PARTITION BY t.doc_id ORDER BY c.c, t.x) AS place FROM t JOIN (SELECT x, count(*) AS c FROM t GROUP BY x) c USING (x)
), q AS (SELECT doc_id, n, x FROM f WHERE place <= n - (n * 80 + 99) // 100 + 1
), m AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM q a JOIN q b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), p AS (
  SELECT m.a, m.b, count(*) AS c FROM m JOIN t ta ON ta.doc_id = m.a JOIN t tb ON tb.doc_id = m.b AND tb.x = ta.x GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""
