"""Suffix-array dedup: bytes that a string of ``window`` bytes covers, which also starts anywhere else, are removed.

Every window of a text is dealt by the smallest hash of the short strings in it (its anchor), so equal windows meet,
wherever they are, while only one in some hundred positions is an anchor. Neighbouring windows with one anchor make a
context. Equal contexts are counted, not gathered; contexts that stand alone with their anchor are done. What is left goes
to suffix arrays: the concatenated contexts of a task are sorted in two stages (the suffixes smaller than their successors
directly, the others induced by scanning the buckets), the common prefixes of neighbours in the array are computed from
their bytes, and neighbours whose prefix reaches the window are repeats. An anchor with more distinct contexts than ``most_contexts`` (a passage in a great share of all texts) is
split further, into blocks of windows and down to single windows, which are counted. All of it is exact but for 64-bit hash values.

Null and empty texts have no bytes (the digest of the empty string). Texts shorter than the window lose nothing. Rows that
repeat both doc_id and text lose what each other repeats; any other rows are texts of their own, whatever their ids. An
empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import only, raw_texts, text_slices, width
from .kernels import _BYTES, _power, mix

_U = np.uint64


@dataclass(frozen=True)
class SuffixParameters:
    window: int = 400
    #: Length of the short strings whose hashes choose the anchors.
    anchor: int = 32
    #: Distinct contexts of one anchor that a suffix array takes, at most.
    most_contexts: int = 2_048
    #: Neighbouring windows of a context beyond that which are compared as one first.
    block: int = 16
    #: Contexts of a task's suffix array, about.
    task_contexts: int = 2_500
    #: Windows of a text looked at in one step.
    step: int = 1 << 20


class Hashes:
    """Hashes of any substrings of a buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up[: len(buf)], dtype=np.uint64)))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of substrings that are only compared with others of the same length."""
        with np.errstate(over="ignore"):
            return (self.total[end] - self.total[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def contexts(buf: np.ndarray, p: SuffixParameters) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, number of windows) of each context of one text."""
    n = len(buf) - p.window + 1
    parts = []
    for lo in range(0, max(n, 0), p.step):
        piece = buf[lo : min(lo + p.step, n) + p.window - 1]
        m, w = len(piece) - p.window + 1, p.window - p.anchor + 1
        h = Hashes(piece)
        at = np.arange(len(piece) - p.anchor + 1)
        gram = h.of(at, at + p.anchor)
        # the leftmost smallest hash of each window, by minima from both ends of blocks of one window's length
        key = (gram & _U(~0xFFFFFF & (2**64 - 1))) | at.astype(np.uint64)
        full = -(-len(key) // w) * w
        grid = np.concatenate((key, np.full(full - len(key), 2**64 - 1, np.uint64))).reshape(-1, w)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & _U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.concatenate((first, [m])))
        # the hash of a context also fixes where its anchor is
        ctx = mix(h.of(first, first + size + p.window - 1) ^ (anchor[first] - first).astype(np.uint64))
        parts.append((gram[anchor[first]].view(np.int64), ctx.view(np.int64), first + lo, size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in order of their first ``depth`` bytes at least, by two-stage sorting."""
    n, text = len(t), t.tobytes()
    # a suffix is smaller than its successor if the next different byte is greater; the end is smaller than any byte
    step = np.flatnonzero(t[1:] != t[:-1])
    run_end = np.concatenate((step, [n - 1]))
    rises = np.concatenate((t[step] < t[step + 1], [False]))
    small = np.repeat(rises, np.diff(np.concatenate(([-1], run_end))))
    at = np.flatnonzero(small)
    pair = (t[at].astype(np.uint16) << 8) | t[at + 1]
    order = np.argsort(pair, kind="stable")
    at, pair = at[order], pair[order]
    cut = np.concatenate(([0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(at)])).tolist()
    direct = np.empty(len(at), np.int64)
    for i, j in zip(cut, cut[1:], strict=False):
        if j - i > 1:
            mine = at[i:j].tolist()
            heads = [text[x : x + depth] for x in mine]
            direct[i:j] = at[i:j][sorted(range(j - i), key=heads.__getitem__)]
        else:
            direct[i:j] = at[i:j]
    ends = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def send(found: np.ndarray, c: int) -> np.ndarray:
        """Places the larger predecessors of sorted suffixes; gives back those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        own = t[before]
        same = before[own == c]
        more, own = before[own > c], own[own > c]
        if len(more):
            o = np.argsort(own, kind="stable")
            more, own = more[o], own[o]
            edge = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
            for i, j in zip(edge, edge[1:], strict=False):
                waiting[own[i]].append(more[i:j])
        return same

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = send(wave, c)
        mine = direct[ends[c] : ends[c + 1]]
        if len(mine):
            out.append(mine)
            send(mine, c)
    return np.concatenate(out)


def prefixes(t: np.ndarray, sa: np.ndarray, window: int, most: int = 1 << 22) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in a suffix array, all of ``window`` bytes at least; no more than that.

    A few words of eight bytes tell most neighbours apart. The rest are taken in the order of the text: where a pair and the
    pair one byte on have the same distance, one comparison of the bytes from the first to the last serves the whole run.
    ``most`` bytes are compared at a time.
    """
    a, b = sa[:-1].astype(np.int64), sa[1:].astype(np.int64)
    out = np.zeros(len(a), np.int64)
    raw, rest = t.tobytes(), np.arange(len(a))
    words = np.ndarray((max(len(t) - 7, 0),), np.uint64, raw, 0, (1,)) if len(t) > 7 else np.zeros(0, np.uint64)
    for at in range(0, min(window // 8, 4) * 8, 8):
        x = words[a[rest] + at] ^ words[b[rest] + at]
        ends = np.flatnonzero(x)
        lowest = x[ends] & (~x[ends] + _U(1))
        out[rest[ends]] = at + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        rest = rest[x == 0]
    rest = rest[np.argsort(a[rest], kind="stable")]
    a, b = a[rest], b[rest]
    if not len(a):
        return out
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1))))
    size = np.diff(np.concatenate((first, [len(a)])))
    # a run much longer than the window is cut, so that no step holds more than it should
    pieces = -(-size // most)
    own = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, size = first[own] + nth * most, np.minimum(size[own] - nth * most, most)
    work = np.cumsum(size + window - 1)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most, side="right")))
        span = size[lo:hi] + window - 1
        ends = np.cumsum(span)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - span, span)
        i = np.repeat(first[lo:hi], span)
        differ = t[a[i] + inner] != t[b[i] + inner]
        place = np.arange(len(differ))
        stop = np.minimum.accumulate(np.where(differ, place, len(differ) + window)[::-1])[::-1]
        mine = inner < np.repeat(size[lo:hi], span)
        out[rest[(i + inner)[mine]]] = np.minimum(stop[mine] - place[mine], window)
        lo = hi
    return out


def repeated(texts: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each context (of so many equal ones) its windows that start twice or more anywhere among all of them."""
    t = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    sa = suffix_array(t, window)
    sa = sa[sa <= len(t) - window]
    near = prefixes(t, sa, window) >= window
    group = np.concatenate(([0], np.cumsum(~near)))
    owner = np.searchsorted(starts, sa, side="right") - 1
    inside = sa + window <= starts[owner + 1]
    weight = np.where(inside, np.array(counts, np.float64)[owner], 0)
    often = np.bincount(group, weights=weight) >= 2
    hit = inside & often[group]
    own, pos = owner[hit], (sa - starts[owner])[hit]
    order = np.lexsort((pos, own))
    own, pos = own[order], pos[order]
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    return [pos[i:j] for i, j in zip(cut, cut[1:], strict=False)]


def ranges(windows: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) of sorted window starts."""
    if not len(windows):
        return []
    gap = np.flatnonzero(np.diff(windows) > 1)
    return list(zip(windows[np.concatenate(([0], gap + 1))].tolist(), windows[np.concatenate((gap, [len(windows) - 1]))].tolist(), strict=True))


RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the key that tells texts apart: of the id and the text."""
    return only(docs).withColumn("rid", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, p: SuffixParameters = SuffixParameters()) -> DataFrame:
    """(rid, lo, hi): runs of repeated windows, from the first window's start to the last one's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            rids = np.asarray(b.column("rid"))
            found = [contexts(np.frombuffer(t, np.uint8), p) for t in raw_texts(b.column("text"))]
            n = [len(f[0]) for f in found]
            cat = [np.concatenate(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_pydict({"rid": pa.array(np.repeat(rids, n)), "anchor": pa.array(cat[0]), "ctx": pa.array(cat[1]), "at": pa.array(cat[2].astype(np.int32)), "n": pa.array(cat[3].astype(np.int32))})

    long = _keyed(docs).where(F.octet_length("text") >= p.window)
    every = stored(long.select("rid", "text").mapInArrow(cut, "rid long, anchor long, ctx long, at int, n int"))
    distinct = every.groupBy("anchor", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "at", "n")).alias("x"))
    totals = distinct.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    shared = stored(distinct.join(totals, "anchor").select("anchor", "ctx", "copies", "kinds", "x.rid", "x.at", "x.n"))
    # contexts that only equal ones share an anchor with: all their windows repeat
    alone = shared.where("kinds = 1").select("anchor", "ctx", F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))).alias("runs"))
    mixed = shared.where("kinds > 1")

    places = mixed.groupBy("rid").agg(F.collect_list(F.struct("anchor", "ctx", "copies", "kinds", "at", "n")).alias("own"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            rows: list[tuple] = []
            for t, own in zip(raw_texts(b.column("text")), b.column("own").to_pylist(), strict=True):
                rows.extend((x["anchor"], x["ctx"], x["copies"], x["kinds"], t[x["at"] : x["at"] + x["n"] + p.window - 1]) for x in own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "ctx", "copies", "kinds", "piece"])

    texts = _keyed(docs).join(places, "rid").select("text", "own").mapInArrow(fetch, "anchor long, ctx long, copies long, kinds long, piece binary")
    pieces = stored(texts)
    buckets = int(max(width(docs.sparkSession), mixed.count() // p.task_contexts + 1))

    def sort(table: pa.Table) -> pa.Table:
        anchors, ctxs = table.column("anchor").to_pylist(), table.column("ctx").to_pylist()
        first = {k: i for i, k in reversed(list(enumerate(zip(anchors, ctxs, strict=True))))}
        keep = sorted(first.values())
        raw, copies = table.column("piece").to_pylist(), table.column("copies").to_pylist()
        found = repeated([raw[i] for i in keep], [copies[i] for i in keep], p.window)
        hit = [(i, ranges(w)) for i, w in zip(keep, found, strict=True) if len(w)]
        return pa.table({"anchor": pa.array([anchors[i] for i, _ in hit], pa.int64()), "ctx": pa.array([ctxs[i] for i, _ in hit], pa.int64()), "runs": pa.array([[{"lo": a, "hi": b} for a, b in r] for _, r in hit], RUNS)})

    out_schema = "anchor long, ctx long, runs array<struct<lo:int,hi:int>>"
    sorted_out = pieces.where(F.col("kinds") <= p.most_contexts).groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")).applyInArrow(sort, out_schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for anchor, ctx, copies, piece in zip(*(b.column(c).to_pylist() for c in ("anchor", "ctx", "copies", "piece")), strict=True):
                h, n = Hashes(np.frombuffer(piece, np.uint8)), len(piece) - p.window + 1
                at = np.arange(len(piece) - p.anchor + 1)
                here = int(np.flatnonzero(h.of(at, at + p.anchor).view(np.int64) == anchor)[0])
                windows = h.of(np.arange(n), np.arange(n) + p.window).view(np.int64)
                # blocks end at fixed distances from the anchor, so equal ones have equal bounds
                edge = np.unique(np.concatenate(([0], np.arange(here % p.block, n, p.block), [n])))
                subs = h.of(edge[:-1], edge[1:] + p.window - 1).view(np.int64)
                rows.extend((anchor, ctx, copies, int(i), s, windows[i:j]) for i, j, s in zip(edge, edge[1:], subs.tolist(), strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["anchor", "ctx", "copies", "lo", "sub", "windows"])

    # too many kinds: equal blocks of windows are counted, and windows of the blocks that stand alone, against both
    hot = pieces.where(F.col("kinds") > p.most_contexts).dropDuplicates(["anchor", "ctx"]).select("anchor", "ctx", "copies", "piece")
    cut_up = hot.mapInArrow(blocks, "anchor long, ctx long, copies long, lo int, sub long, windows array<long>")
    kinds = cut_up.groupBy("sub").agg(F.sum("copies").alias("c"), F.first("windows").alias("w")).where("c > 1")
    whole = cut_up.join(kinds.select("sub"), "sub", "left_semi").select("anchor", "ctx", "lo", (F.col("lo") + F.size("windows") - 1).alias("hi"))
    lone = cut_up.join(kinds.select("sub"), "sub", "left_anti").select("anchor", "ctx", "copies", "lo", F.posexplode("windows").alias("i", "h"))
    counts = lone.select("h", "copies").unionByName(kinds.select(F.explode("w").alias("h"), F.col("c").alias("copies"))).groupBy("h").agg(F.sum("copies").alias("c")).where("c > 1")
    single = lone.join(counts, "h", "left_semi").select("anchor", "ctx", (F.col("lo") + F.col("i")).alias("lo"), (F.col("lo") + F.col("i")).alias("hi"))
    split = whole.unionByName(single).groupBy("anchor", "ctx").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    marks = alone.unionByName(sorted_out).unionByName(split)
    hits = every.join(marks, ["anchor", "ctx"]).select("rid", "at", F.explode("runs").alias("r"))
    return hits.select("rid", (F.col("at") + F.col("r.lo")).alias("lo"), (F.col("at") + F.col("r.hi")).alias("hi"))


def cover(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) that windows starting in the runs cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, p: SuffixParameters = SuffixParameters()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay, as binary."""
    return _final(docs, p, False)


def report(docs: DataFrame, p: SuffixParameters = SuffixParameters()) -> DataFrame:
    """One row per document, for the query."""
    return _final(docs, p, True)


def _final(docs: DataFrame, p: SuffixParameters, digest: bool) -> DataFrame:
    found = repeats(docs, p).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    both = _keyed(docs).join(found, "rid", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts, rows = raw_texts(b.column("text")), []
            for t, runs in zip(texts, b.column("runs").to_pylist(), strict=True):
                spans = cover([(r["lo"], r["hi"]) for r in runs or ()], p.window)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(t[at:s])
                    at = e
                left = b"".join([*kept, t[at:]])
                rows.append((len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digest else left))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))
