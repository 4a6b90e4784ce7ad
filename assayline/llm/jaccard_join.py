"""N-gram Jaccard self-join of documents, exact, by universe partition and the pigeonhole principle.

A document's set holds its distinct word shingles. Sets are placed in size bands; in a band all tokens are hashed into m
segments, and two sets of similarity t or more differ in at most H = (1 - t) / (1 + t) * (|x| + |y|) tokens, so they agree
on at least m - H whole segments. Each set therefore need not index all its segments. Allocation by cost leaves out the
empty ones and those whose tokens are the most frequent; since the order of cost is the same for all sets, the cheapest
agreed segment of a linked pair is indexed by both. In bands of small sets, where segments are few, fewer and larger
segments are indexed together with their one-deletion neighbourhoods (a segment without one of its tokens), which tolerate
two differences each. A set indexes into its own band and into the next smaller one if a partner can be there.

Equal sets are one node from the start. Candidates, their verification on whole sets and components are ``linking``'s: no
link between components is lost, and no group is expanded into all pairs.

Empty or null texts have the empty set, which links with nothing. A text of fewer words than a shingle has one shingle,
the whole sequence. Rows are told apart by doc_id and text: different texts that share a doc_id are nodes of their own, and
each row shows its own component; rows that repeat both are one node. A row with a null doc_id links like any other; its
component is the smallest doc_id among the linked rows, null if none has one. An empty table gives no rows. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, freed, stored
from . import linking
from .common import only, raw_texts, text_slices, width
from .kernels import Words, mix

_U = np.uint64


@dataclass(frozen=True)
class JoinParameters:
    words: int = 5
    #: Similarity of a link, in percent: 100 * intersection >= percent * union.
    percent: int = 75
    #: Segments for each token of a band's largest set.
    segments: float = 0.45
    #: Largest set of the bands that use one-deletion neighbourhoods.
    small: int = 11
    #: Documents (hashed choice) in which frequent tokens and signatures are looked for; they only steer cost, never the result.
    sample_docs: int = 4_000
    frequent: int = 50_000
    link: linking.LinkParameters = field(default_factory=linking.LinkParameters)


def bands(percent: int, most: int = 1 << 40) -> list[int]:
    """Largest size of each band; a partner of a set is at most one band below."""
    ends, lo = [], 1
    while lo < most:
        hi = max(lo, lo * 100 // percent)
        ends.append(hi)
        lo = hi + 1
    return ends


class Signer:
    """Signatures of sets."""

    def __init__(self, p: JoinParameters, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        self.p, self.ends = p, np.array(bands(p.percent), np.int64)
        self.tokens, self.counts = frequent or (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def most_different(self, x, y):
        return (100 - self.p.percent) * (x + y) // (100 + self.p.percent)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(set, signature) of all the signatures of some sets, all sets at once."""
        t, size = self.p.percent, np.fromiter(map(len, sets), np.int64, len(sets))
        band = np.searchsorted(self.ends, size)
        below = self.ends[np.maximum(band - 1, 0)]
        down = np.flatnonzero((size > 0) & (band > 0) & (100 * below >= t * size))
        own = np.flatnonzero(size > 0)
        parts = [self._space(sets, own, band[own], self.most_different(size[own], size[own] * 100 // t)), self._space(sets, down, band[down] - 1, self.most_different(size[down], below[down]))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _space(self, sets: list[np.ndarray], who: np.ndarray, band: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the sets ``who`` among those of a band each, whose partners there differ in so many tokens at most."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        salt, tag = (band + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15), band.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        top = self.ends[band]
        for i in np.flatnonzero(top <= self.p.small):
            sig = self._neighbourhoods(mix(sets[who[i]] ^ salt[i]), int(top[i]), tag[i])
            out.append((np.full(len(sig), who[i]), sig))
        large = top > self.p.small
        who, salt, tag, top, need = who[large], salt[large], tag[large], top[large], most[large] + 1
        if len(who):
            tokens = np.concatenate([sets[i] for i in who])
            own = np.repeat(np.arange(len(who)), [len(sets[i]) for i in who])
            m = np.ceil(self.p.segments * top).astype(np.int64) + 8
            salted = mix(tokens ^ salt[own])
            seg = (salted >> _U(33)).astype(np.int64) % m[own]
            order = np.argsort((own << 32) | seg, kind="stable")
            own, seg = own[order], seg[order]
            first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (seg[1:] != seg[:-1]))))
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(salted[order]), first)
                own, seg = own[first], seg[first]
                sig = mix(sums + tag[own] + (seg + 1).astype(np.uint64) * _U(0xA0761D6478BD642F))
            cost = np.zeros(len(sig), np.int64)
            if len(self.tokens):  # a segment is as frequent as its rarest token at most
                at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
                cost = np.minimum.reduceat(np.where(self.tokens[at] == tokens, self.counts[at], 0)[order], first)
            order = np.lexsort((sig, cost, own))
            start = np.searchsorted(own, np.arange(len(who) + 1))
            rank = np.arange(len(own)) - start[own]
            keep = order[rank < need[own]]
            out.append((who[own[keep]], sig[keep]))
            # where too few segments hold a token, empty ones agree as well
            for i in np.flatnonzero(need > np.diff(start)):
                empty = np.setdiff1d(np.arange(m[i]), seg[start[i] : start[i + 1]])
                if need[i] >= m[i]:
                    empty = empty[: need[i] - (start[i + 1] - start[i])]
                with np.errstate(over="ignore"):
                    out.append((np.full(len(empty), who[i]), mix(tag[i] + (empty + 1).astype(np.uint64) * _U(0xE7037ED1A0B428DB))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _neighbourhoods(self, salted: np.ndarray, top: int, tag: _U) -> np.ndarray:
        """Each segment and each segment without one token; one of m segments differs by at most one token."""
        most = self.most_different(top, top * 100 // self.p.percent)
        m = (most + 2) // 2
        seg = (salted >> _U(33)).astype(np.int64) % m
        out, worth = [], mix(salted)
        with np.errstate(over="ignore"):
            for j in range(m):
                mine = worth[seg == j]
                whole = mine.sum(dtype=np.uint64)
                sums = np.concatenate(([whole], whole - mine)) if most and len(mine) else np.array([whole], np.uint64)
                out.append(mix(sums + tag + _U((j + 1) * 0xA0761D6478BD642F & (2**64 - 1))))
        return np.concatenate(out)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words([t.translate(_LOWER) for t in texts])
    at, h = w.grams(k)
    cut, n = np.searchsorted(w.doc[at], np.arange(len(texts) + 1)), w.counts()
    out = []
    for i in range(len(texts)):
        if n[i] >= k:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n[i]:
            whole = w.hashes[w.first[i] : w.first[i + 1]]
            out.append(np.frombuffer(hashlib.blake2b(whole.tobytes(), digest_size=8, person=b"short").digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame) -> DataFrame:
    """The id, the text, and the key that tells rows apart: of both."""
    return only(docs).withColumn("rid", F.xxhash64("doc_id", "text"))


def sets(docs: DataFrame, p: JoinParameters) -> DataFrame:
    """(rid, doc_id, n, fp, bitmap) of each document; fp is null for the empty set, and so is its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = shingles(raw_texts(b.column("text")), p.words)
            yield pa.RecordBatch.from_pydict({"rid": b.column("rid"), "doc_id": b.column("doc_id"), "n": pa.array([len(x) for x in found], pa.int64()), "fp": pa.array([fingerprint(x) if len(x) else None for x in found], pa.int64()), "bitmap": linking.bitmaps(found, p.link.bits)})

    return keyed(docs).mapInArrow(run, "rid long, doc_id long, n long, fp long, bitmap binary")


def _sampled(docs: DataFrame, every: int, p: JoinParameters, what) -> DataFrame:
    """(s): what ``what`` gives for the sets of the sampled documents."""
    picked = keyed(docs).where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield pa.RecordBatch.from_pydict({"s": pa.array(what(shingles(raw_texts(b.column("text")), p.words)).view(np.int64))})

    return picked.mapInArrow(run, "s long")


def frequent_tokens(docs: DataFrame, every: int, p: JoinParameters) -> tuple[np.ndarray, np.ndarray]:
    got = _sampled(docs, every, p, np.concatenate).groupBy("s").count().where("count >= 4").orderBy(F.desc("count"), "s").limit(p.frequent).collect()
    tokens = np.array([r["s"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["count"] for r in got], np.int64)[order]


def signatures(docs: DataFrame, p: JoinParameters, buckets: int, frequent: tuple, hot: linking.Hot) -> DataFrame:
    """(bucket, packed): signatures and their sets' fingerprints, dealt by signature; equal sets of a task once."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = sent.value
        signer, seen, sig, fps, sizes, held = Signer(p, frequent), set(), [], [], [], 0
        for b in text_slices(batches):
            fresh: dict[int, np.ndarray] = {}
            for x in shingles(raw_texts(b.column("text")), p.words):
                if len(x) and (f := fingerprint(x)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(f)
                    fresh[f] = x
            own, s = signer.signatures(list(fresh.values()))
            sig.append(s)
            fps.append(np.array(list(fresh), np.int64)[own])
            sizes.append(linking.steps(np.fromiter(map(len, fresh.values()), np.int64, len(fresh)))[own])
            held += len(s)
            if held > linking.PORTION:
                packed = linking.pack(sig, fps, sizes, buckets, hot)
                sig, fps, sizes, held = [], [], [], 0
                yield packed
        if held:
            yield linking.pack(sig, fps, sizes, buckets, hot)

    return only(docs).mapInArrow(run, "bucket int, packed binary")


def bodies(docs: DataFrame, nodes: DataFrame, fps: DataFrame, identity: Callable[[np.ndarray], int], p) -> DataFrame:
    """(fp, body) of the sets ``fps``, and of a few others: texts are picked where they lie, by the rows that stand for the
    sets in ``nodes``. A body's node is made from its own set by ``identity``."""
    rids = stored(nodes.join(fps, "fp").select("rid"))
    texts = linking.marked(keyed(docs).select("rid", "text"), linking.marks(rids, p.link))
    dropped(rids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            raw = raw_texts(b.column("text"))
            found = [(identity(s), x) for s, x in zip(shingles(raw, p.words), raw, strict=True) if len(s)]
            yield pa.RecordBatch.from_pydict({"fp": pa.array([f for f, _ in found], pa.int64()), "body": pa.array([x for _, x in found], pa.binary())})

    return texts.mapInArrow(run, "fp long, body binary")


def links(docs: DataFrame, p: JoinParameters = JoinParameters()) -> tuple[DataFrame, DataFrame]:
    """``sets`` of every document, and (node, root) of the sets that link with another."""
    spark = docs.sparkSession
    every = stored(sets(docs, p))
    nodes = stored(every.where("fp IS NOT NULL").groupBy("fp").agg(F.min("rid").alias("rid"), F.max("n").alias("n")))
    docs_in, tokens = (x or 0 for x in nodes.agg(F.count("*"), F.sum("n")).first())
    one_in = max(1, docs_in // p.sample_docs)
    frequent = frequent_tokens(docs, one_in, p)
    signer = Signer(p, frequent)
    hot = linking.hot(_sampled(docs, one_in, p, lambda x: signer.signatures(x)[1]), one_in, p.link) if docs_in > p.link.shard_holders else linking.NO_HOT
    buckets = int(max(width(spark), 2 * tokens // (3 * p.link.task_signatures) + 1))
    found = stored(linking.runs(signatures(docs, p, buckets, frequent, hot), hot, p.link))
    freed(spark)
    sketches = linking.by_node(linking.marked(every.where("fp IS NOT NULL").select("fp", "n", "bitmap"), linking.candidates(found, p.link)), docs_in * 8, p.link)
    freed(spark)
    return every, linking.linked(found, sketches, lambda fps: bodies(docs, nodes, fps, fingerprint, p), lambda x: shingles(x, p.words), p.link)


def _components(docs: DataFrame, p: JoinParameters) -> DataFrame:
    """(rid, doc_id, n, component, root) of each document; root is null for the empty set."""
    every, labels = links(docs, p)
    rooted = every.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component"))
    return rooted.join(least, "root", "left")


def components(docs: DataFrame, p: JoinParameters = JoinParameters()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    return _components(docs, p).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, p: JoinParameters = JoinParameters()) -> DataFrame:
    """One row of ``docs`` for each component, the one of the smallest doc_id (a null one is the last); rows without a
    word are all kept."""
    rows = stored(_components(docs, p).where("root IS NOT NULL").groupBy("rid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("at"), F.min("root").alias("root"), F.count("*").alias("copies")))
    keep = rows.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.rid").alias("__kept"))
    go = rows.join(keep, F.col("rid") == F.col("__kept"), "left_anti").select("rid")
    mine = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # references bound to one side keep columns of the same name apart
    out = docs.join(go, mine == go["rid"], "left_anti")
    again = rows.where("copies > 1").select("rid")
    if again.isEmpty():
        return out
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    packed = out.select(F.struct("*").alias("row"), mine.alias("mine"), F.xxhash64(*plain).alias("mark"))
    once = packed.join(again, packed["mine"] == again["rid"], "left_semi").groupBy("mine").agg(F.min_by("row", "mark").alias("row")).select("row.*")
    return out.join(again, mine == again["rid"], "left_anti").unionByName(once)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                    WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, coalesce(len(sh), 0) AS n FROM s
), t AS (SELECT doc_id, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY ALL
"""
