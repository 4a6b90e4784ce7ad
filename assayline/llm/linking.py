"""Links between sets, from signatures to components: shared by the n-gram Jaccard join and line dedup.

Signatures are dealt by value, each with its set's size. A run of equal signatures is cut where sizes lie too far apart for
any link. In each run the smallest holder is the centre, and every other holder of a size near its own is a candidate of it;
runs of three and more holders are kept as well. Candidates are sketched by parity bitmaps, which bound the difference of
two sets from below, and only the pairs that sizes and bitmaps allow are tested: bodies are fetched for these sets alone.
First each set is tested against the smallest centre it has left, which joins most groups of near copies, then against the
others. What the runs still hold in different components is compared by bitmaps: within a block each component offers its
closest pairs to others, a few at first and more in each round, until no block holds any pair back that bitmaps allow. Each
offered pair is verified on whole sets. So no link between components is lost, a group costs links in proportion to its
size and not all its pairs, and no run is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from ..storage import bucketed, dropped, freed, stored
from .common import SLICE_BYTES, width

_U = np.uint64

#: The tokens (sorted, distinct) of each of some bodies.
Tokens = Callable[[list[bytes]], list[np.ndarray]]
#: (fp, body) of the sets of a stored (fp); others and repeats may be among them.
Fetch = Callable[[DataFrame], DataFrame]


#: Signatures that a task holds before it sends them on: packing takes a good hundred bytes for each, and workers that are
#: used again keep what their largest portion took.
PORTION = 500_000


@dataclass(frozen=True)
class LinkParameters:
    #: Similarity of a link, in percent: 100 * intersection >= percent * union.
    percent: int = 75
    #: Bits of a parity bitmap at least; of a larger set it has as many bits as tokens at least.
    bits: int = 1024
    #: Signatures that one task compares.
    task_signatures: int = 1_000_000
    #: Holders of a signature for each of its shards, and signatures that are split in shards at most.
    shard_holders: int = 100_000
    hot: int = 50_000
    #: Holders of a run on each side of a block of comparisons.
    block: int = 2_048
    #: Holders in a task of such comparisons, about.
    task_holders: int = 50_000
    #: Candidates of one centre that are verified together, and tokens of a verification task, about.
    star: int = 256
    task_tokens: int = 1_000_000
    #: Tokens of the sets in a bucket of candidates' bodies, about, and buckets at most.
    bucket_tokens: int = 8_000_000
    most_buckets: int = 50_000
    #: Holders from which on runs of one centre are one run: those of a group of near copies hold nearly the same sets.
    wide: int = 64
    #: Bits for each hash of ``marks``, and bits at most.
    mark_bits: int = 64
    most_bits: int = 1 << 28
    #: Pairs that a component offers from a block in the first round, and the growth from round to round.
    offers: int = 2
    growth: int = 16


class Hot:
    """Signatures that so many sets of a sample hold that one task should not get all holders: how many shards each has.

    They only steer where holders go, never the result.
    """

    def __init__(self, signatures: np.ndarray, shards: np.ndarray):
        order = np.argsort(signatures)
        self.signatures, self.shards = signatures[order].astype(np.uint64), shards[order].astype(np.uint64)

    def of(self, s: np.ndarray) -> np.ndarray:
        """Shards of each signature; 1 for the others."""
        if not len(self.signatures):
            return np.ones(len(s), np.uint64)
        at = np.minimum(np.searchsorted(self.signatures, s), len(self.signatures) - 1)
        return np.where(self.signatures[at] == s, self.shards[at], 1).astype(np.uint64)


NO_HOT = Hot(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def hot(sampled: DataFrame, every: int, p: LinkParameters) -> Hot:
    """From the signatures (long) of one set in ``every``."""
    least = max(4, p.shard_holders // max(every, 1))
    got = sampled.groupBy("s").count().where(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(p.hot).collect()
    shards = -(-np.array([r["count"] for r in got], np.int64) * every // p.shard_holders)
    return Hot(np.array([r["s"] for r in got], np.int64).view(np.uint64)[shards > 1], shards[shards > 1])


class Marks:
    """Which hashes are wanted, a bit for each value of their lowest bits: it passes all of them and a few others."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.mask, self.bytes = bits - 1, np.zeros(bits // 8, np.uint8)
        for i, x in parts:
            self.bytes[i * len(x) : (i + 1) * len(x)] = np.frombuffer(x, np.uint8)

    def of(self, x: np.ndarray) -> np.ndarray:
        at = x & self.mask
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def marks(wanted: DataFrame, p: LinkParameters) -> Marks:
    """Of the hashes (a column of longs) in a stored table; of a bounded size, so that it can be sent to all tasks."""
    bits = 1 << 15
    while bits < min(p.most_bits, p.mark_bits * wanted.count()):
        bits *= 2
    # bitmap functions count from 1, in bitmaps of 4,096 bytes
    at = F.col(wanted.columns[0]).bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    got = wanted.groupBy((F.bitmap_bucket_number(at) - 1).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    return Marks(bits, [(r["i"], bytes(r["bits"])) for r in got])


def marked(df: DataFrame, wanted: Marks) -> DataFrame:
    """The rows whose first column, a long, ``wanted`` passes; what a task remembers having met is left out."""
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            x, keep = np.asarray(b.column(0)), []
            for i in np.flatnonzero(sent.value.of(x)).tolist():
                if (f := int(x[i])) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(f)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return df.mapInArrow(run, df.schema)


#: Logarithm of the ratio of two sizes that are a step apart.
_STEP = 0.05


def steps(n: np.ndarray) -> np.ndarray:
    """Sizes in steps, one byte each; the largest share one."""
    return np.minimum(np.log(np.maximum(n, 1)) / _STEP, 255).astype(np.uint8)


def most_steps(percent: int) -> int:
    """Steps that the sizes of two linked sets are apart at most; one more than need be, for sizes told by short hashes."""
    return int(np.log(100 / percent) / _STEP) + 2


def pack(sig: list[np.ndarray], fps: list[np.ndarray], sizes: list[np.ndarray], buckets: int, hot: Hot) -> pa.RecordBatch:
    """One row for each bucket: the fingerprints, the signatures, the sizes in steps; the three run in parallel."""
    s, f, q = np.concatenate(sig), np.concatenate(fps), np.concatenate(sizes)
    home = (s >> _U(40)) % _U(buckets)
    shards = hot.of(s)
    many = np.flatnonzero(shards > 1)
    home[many] = (home[many] + (f[many].view(np.uint64) >> _U(32)) % shards[many]) % _U(buckets)
    order = np.argsort(home.astype(np.uint32), kind="stable")
    s, f, q, home = s[order], f[order], q[order], home[order]
    cut = np.searchsorted(home, np.arange(buckets + 1).astype(np.uint64))
    full = np.flatnonzero(np.diff(cut))
    low, high = s.astype(np.uint32), (s >> _U(32)).astype(np.uint8)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(full.astype(np.int32)), "packed": pa.array([f[i:j].tobytes() + low[i:j].tobytes() + high[i:j].tobytes() + q[i:j].tobytes() for i, j in zip(cut[full], cut[full + 1], strict=True)], pa.binary())})


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0x9FB21C651E98DF25)
        return x ^ (x >> _U(28))


def runs(dealt: DataFrame, hot: Hot, p: LinkParameters) -> DataFrame:
    """(run, a, b): candidates b of a centre a (run null), and the holders b of each run of three and more (a null).

    Runs with the same holders are one, and so are wide runs with the same centre. The shards of a hot signature are one run
    under one key, whatever they hold.
    """
    known, apart, wide_from = np.unique(hot.signatures & _U((1 << 40) - 1)), most_steps(p.percent), p.wide

    def run(table: pa.Table) -> pa.Table:
        sig, fps, sizes = [], [], []
        for x in table.column("packed").to_pylist():
            n = len(x) // 14
            sizes.append(np.frombuffer(x, np.uint8, n, 13 * n))
            fps.append(np.frombuffer(x, np.int64, n))
            sig.append(np.frombuffer(x, np.uint32, n, 8 * n).astype(np.uint64) | (np.frombuffer(x, np.uint8, n, 12 * n).astype(np.uint64) << _U(32)))
        s, f, q = np.concatenate(sig), np.concatenate(fps), np.concatenate(sizes)
        order = np.argsort(s, kind="stable")
        s, f, q = s[order], f[order], q[order]
        # most signatures have one holder; only the others are put in order
        same = s[1:] == s[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if len(known):
            shared |= np.isin(s, known)
        s, f, q = s[shared], f[shared], q[shared].astype(np.int64)
        order = np.lexsort((q, s))
        s, f, q = s[order], f[order], q[order]
        # a run is cut where its sizes are too far apart; of a hot signature others have a part
        far = np.diff(q) > apart
        if len(known):
            far &= ~np.isin(s[1:], known)
        part = np.concatenate(([0], np.cumsum((s[1:] != s[:-1]) | far))) if len(s) else np.zeros(0, np.int64)
        order = np.lexsort((f, part))
        s, f, q, part = s[order], f[order], q[order], part[order]
        fresh = np.concatenate(([True], (part[1:] != part[:-1]) | (f[1:] != f[:-1]))) if len(s) else np.zeros(0, bool)
        s, f, q, part = s[fresh], f[fresh], q[fresh], part[fresh]
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((start, [len(s)])))
        if not len(start):
            none = pa.array([], pa.int64())
            return pa.table({"run": none, "a": none, "b": none})
        key = np.add.reduceat(_mixed(f.view(np.uint64)), start) ^ (size.astype(np.uint64) << _U(56))
        split = np.isin(s[start], known)
        key[split] = _mixed(s[start][split] + _U(1 << 41))
        _, once = np.unique(key, return_index=True)
        keep = np.zeros(len(start), bool)
        keep[once] = True
        keep |= split
        keep &= (size > 1) | split
        start, size, key, split = start[keep], size[keep], key[keep], split[keep]
        own = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        b, centre = f[at], f[start][own]
        pair = (b != centre) & (np.abs(q[at] - q[start][own]) <= apart)
        ends = np.stack((centre[pair], b[pair]))
        ends = np.unique(ends, axis=1) if ends.size else ends
        wide = ((size > 2) | split)[own]
        key = np.where((size >= wide_from) & ~split, _mixed(f[start].view(np.uint64) + _U(1 << 42)), key)
        held = np.stack((key[own[wide]].view(np.int64), b[wide]))
        held = np.unique(held, axis=1) if held.size else held
        k, m = ends.shape[1], held.shape[1]
        return pa.table({"run": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(held[0])]), "a": pa.concat_arrays([pa.array(ends[0]), pa.nulls(m, pa.int64())]), "b": pa.concat_arrays([pa.array(ends[1]), pa.array(held[1])])})

    return dealt.groupBy("bucket").applyInArrow(run, "run long, a long, b long")


def candidates(found: DataFrame, p: LinkParameters) -> Marks:
    """The sets that ``runs`` found."""
    fps = stored(found.select(F.explode(F.array_compact(F.array("a", "b"))).alias("fp")).distinct())
    out = marks(fps, p)
    dropped(fps)
    return out


def by_node(material: DataFrame, tokens: int, p: LinkParameters) -> DataFrame:
    """``material`` stored in buckets by fp, each once, so that rounds of ``linked`` deal pairs; of so many tokens, about."""
    return bucketed(material, "fp", int(min(p.most_buckets, max(width(material.sparkSession), tokens // p.bucket_tokens + 1))))


#: Bits whose parities are counted together, and bytes of bitmaps that are compared together, about.
_CELLS, _COMPARED = 1 << 22, 1 << 24


def parities(tokens: np.ndarray, first: np.ndarray, bits: int) -> list[bytes]:
    """Bitmaps of the sets tokens[first[i]:first[i + 1]]: two of them differ in at most as many bits as their sets in tokens.

    A set has ``bits`` times the least power of two that makes at least as many bits as it has tokens: of fewer bits half are odd
    in any large set, so two sets that share little would differ as little as two that link.
    """
    n = np.diff(first)
    out: list[bytes] = [b""] * len(n)
    doublings = np.ceil(np.log2(np.maximum(n, bits) / bits)).astype(np.int64)
    for k in np.unique(doublings).tolist():
        which, wide = np.flatnonzero(doublings == k), bits << k
        step = max(1, _CELLS // wide)
        for lo in range(0, len(which), step):
            part = which[lo : lo + step]
            many = n[part]
            own = np.repeat(np.arange(len(part)), many)
            at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[part], many)
            bit = ((tokens[at] >> _U(20)) % _U(wide)).astype(np.int64)
            odd = (np.bincount(own * wide + bit, minlength=len(part) * wide) & 1).astype(np.uint8)
            packed = np.packbits(odd.reshape(len(part), wide), axis=1)
            for i, x in zip(part.tolist(), packed, strict=True):
                out[i] = x.tobytes()
    return out


def bitmaps(sets: list[np.ndarray], bits: int) -> pa.Array:
    """Parity bitmaps of some sets, null for the empty one."""
    maps = parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), bits) if sets else []
    return pa.array([x if len(s) else None for s, x in zip(sets, maps, strict=True)], pa.binary())


def slices(bodies: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    at, held = 0, 0
    for i, x in enumerate(bodies):
        if held and held + len(x) > most:
            yield bodies[at:i]
            at, held = i, 0
        held += len(x)
    if at < len(bodies):
        yield bodies[at:]


def sketched(bodies: list[bytes], tokens_of: Tokens, bits: int) -> tuple[pa.Array, pa.Array]:
    """Sizes and bitmaps of the sets of some bodies."""
    n: list[int] = []
    maps: list[bytes] = []
    for part in slices(bodies):
        sets = tokens_of(part)
        first = np.cumsum([0, *map(len, sets)])
        n.extend(map(len, sets))
        maps.extend(parities(np.concatenate(sets), first, bits))
    return pa.array(n, pa.int64()), pa.array(maps, pa.binary())


class Bitmaps:
    """Parity bitmaps of several lengths, each twice the one before. Two are compared at the shorter one's length: the halves of
    the longer one, one over the other, are its set's bitmap of half the length."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(x) // 8 for x in maps], np.int64)
        self.row, self.held = np.zeros(len(maps), np.int64), {}
        for w in np.unique(self.words).tolist():
            which = np.flatnonzero(self.words == w)
            self.row[which] = np.arange(len(which))
            self.held[w] = np.frombuffer(b"".join([maps[i] for i in which.tolist()]), np.uint64).reshape(-1, w)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps x and y, by number, differ."""
        out = np.zeros(len(x), np.int64)
        kinds, own = np.unique(np.stack((self.words[x], self.words[y])), axis=1, return_inverse=True)
        for i, (u, v) in enumerate(kinds.T.tolist()):
            which = np.flatnonzero(own.ravel() == i)
            step = max(1, _COMPARED // (8 * max(u, v)))
            for lo in range(0, len(which), step):
                part = which[lo : lo + step]
                one, two = self.held[u][self.row[x[part]]], self.held[v][self.row[y[part]]]
                while one.shape[1] > two.shape[1]:
                    one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
                while two.shape[1] > one.shape[1]:
                    two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
                out[part] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
        return out


def close(pairs: DataFrame, sketches: DataFrame, p: LinkParameters) -> DataFrame:
    """(a, b, n) of the pairs whose sizes and bitmaps allow a link, with the size of b's set."""
    one, two = (sketches.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bitmap_{k}")) for k in "ab")
    t = p.percent
    both = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, at = Bitmaps(b.column("bitmap_a").to_pylist() + b.column("bitmap_b").to_pylist()), np.arange(b.num_rows)
            n = np.asarray(b.column("n_a")) + np.asarray(b.column("n_b"))
            ok = maps.differ(at, at + b.num_rows) * (100 + t) <= (100 - t) * n
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("n_b")], ["a", "b", "n"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(run, "a long, b long, n long")


def verified(pairs: DataFrame, bodies: DataFrame, tokens_of: Tokens, p: LinkParameters) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of whole sets; ``pairs`` is a stored table, with the size n of b's.

    A block holds some centres with their candidates, each set once; a centre of many candidates is in several blocks.
    """
    spark = pairs.sparkSession
    blocks = int(max(width(spark), 2 * (pairs.agg(F.sum("n")).first()[0] or 0) // p.task_tokens + 1))
    centres = pairs.groupBy("a").agg(F.count("*").alias("m"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / p.star))
    placed = pairs.join(centres, "a").select("a", "b", F.pmod(F.xxhash64("a", chunk), F.lit(blocks)).alias("block"))
    members = placed.select(F.col("block").alias("of"), F.explode(F.array("a", "b")).alias("fp")).distinct().join(bodies.select("fp", "body"), "fp")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        have: dict[int, np.ndarray] = {}
        fps, at = left.column("fp").to_pylist(), 0
        for part in slices(left.column("body").to_pylist()):
            have.update(zip(fps[at : at + len(part)], tokens_of(part), strict=True))
            at += len(part)
        out = []
        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True):
            x, y = have[a], have[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * shared >= p.percent * (len(x) + len(y) - shared):
                out.append((a, b))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return members.groupBy("of").cogroup(placed.groupBy("block")).applyInArrow(check, "a long, b long")


def _ranked(group: np.ndarray, gap: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group, gap and pair, and each row's rank within its group."""
    order = np.lexsort((b, a, gap, group))
    own = group[order]
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    return order, np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate((start, [len(own)]))))


def offered(cell: np.ndarray, is_left: np.ndarray, fp: np.ndarray, label: np.ndarray, n: np.ndarray, bits: np.ndarray | Bitmaps, offers: int, percent: int, most: int = 1 << 18, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of the closest pairs that each left component offers in each cell, and the cells that hold pairs back.

    Left rows are compared with all right rows of their cell; ``most`` comparisons are held at a time. ``numbers`` has the
    number of each row's bitmap, where rows share some.
    """
    maps = bits if isinstance(bits, Bitmaps) else Bitmaps([x.tobytes() for x in bits])
    order = np.lexsort((is_left, cell))
    cell, is_left, fp, label, n, number = (x[order] for x in (cell, is_left, fp, label, n, np.arange(len(cell)) if numbers is None else numbers))
    _, start, own = np.unique(cell, return_index=True, return_inverse=True)
    rights = np.bincount(own, weights=~is_left, minlength=len(start)).astype(np.int64)
    left = np.flatnonzero(is_left)
    work = np.cumsum(rights[own[left]])
    kept, held, at = [], [], 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, side="right")))
        x = left[at:to]
        many = rights[own[x]]
        y = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[own[x]], many)
        x = np.repeat(x, many)
        ok = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        x, y = x[ok], y[ok]
        gap = maps.differ(number[x], number[y])
        ok = gap * (100 + percent) <= (100 - percent) * (n[x] + n[y])
        x, y, gap = x[ok], y[ok], gap[ok] / (n[x[ok]] + n[y[ok]])
        kept.append((own[x], label[x], gap, np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])))
        if to == len(left) or sum(len(k[0]) for k in kept) > 4 * most:
            c, l, gap, a, b = (np.concatenate(z) for z in zip(*kept, strict=True))
            _, group = np.unique(np.stack((c.astype(np.int64), l)), axis=1, return_inverse=True)
            order, rank = _ranked(group, gap, a, b)
            held.append(np.unique(c[order[rank >= offers]]))
            best = order[rank < offers]
            kept = [(c[best], l[best], gap[best], a[best], b[best])]
        at = to
    if not kept:
        none = np.zeros(0, np.int64)
        return none, none, none
    back = np.unique(np.concatenate(held))
    return kept[0][3], kept[0][4], cell[start[back]]


def across(holders: DataFrame, sketches: DataFrame, labels: DataFrame, offers: int, p: LinkParameters) -> DataFrame:
    """(run, a, b): the closest pairs of runs' holders in different components that bitmaps allow, so many for each component
    of a cell (run null), and the runs that hold pairs back (a and b null).

    Of a run, the holders outside its largest component are compared with all others, in cells that bound both sides.
    """
    known = holders.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("run", "fp", F.coalesce("root", "fp").alias("label"))
    parts = known.groupBy("run", "label").agg(F.count("*").alias("m"))
    split = parts.groupBy("run").agg(F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    split = stored(split.select("run", F.col("top.label").alias("most"), "size", (F.col("size") - F.col("top.m")).alias("few"), F.ceil(F.col("size") / p.block).cast("int").alias("rights"), F.ceil((F.col("size") - F.col("top.m")) / p.block).cast("int").alias("lefts")))
    work = split.agg(F.sum(F.col("size") * F.col("lefts") + F.col("few") * F.col("rights"))).first()[0] or 0
    tasks = int(max(width(holders.sparkSession), work // p.task_holders + 1))
    rows = known.join(split, "run").join(sketches.select("fp", "n", "bitmap"), "fp")
    mine = lambda k: F.pmod(F.xxhash64("fp"), k).cast("int")
    # a holder is on the right of one cell in each row of cells and, outside the largest component, on the left of one in
    # each column; where both are the same cell it goes there once, for both
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("tinyint").alias("role"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    few = F.col("label") != F.col("most")
    right = F.transform(upto("lefts"), lambda i: cell(i, mine(F.col("rights")), F.when(few & (i == mine(F.col("lefts"))), 2).otherwise(0)))
    left = F.transform(F.filter(upto("rights"), lambda j: few & (j != mine(F.col("rights")))), lambda j: cell(mine(F.col("lefts")), j, F.lit(1)))
    rows = rows.withColumn("cell", F.explode(F.concat(right, left)))

    def run(table: pa.Table) -> pa.Table:
        cell, role, fp, label, n = (np.asarray(table.column(c)) for c in ("cell", "role", "fp", "label", "n"))
        maps = Bitmaps(table.column("bitmap").to_pylist())
        rights, lefts = np.flatnonzero(role != 1), np.flatnonzero(role > 0)
        at, is_left = np.concatenate((rights, lefts)), np.repeat([False, True], [len(rights), len(lefts)])
        a, b, back = offered(cell[at], is_left, fp[at], label[at], n[at], maps, offers, p.percent, numbers=at)
        runs = np.asarray(table.column("run"))[np.isin(cell, back)]
        runs = np.unique(runs)
        ends = np.unique(np.stack((a, b)), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        k, m = ends.shape[1], len(runs)
        none = lambda x: pa.nulls(x, pa.int64())
        return pa.table({"run": pa.concat_arrays([none(k), pa.array(runs, pa.int64())]), "a": pa.concat_arrays([pa.array(ends[0]), none(m)]), "b": pa.concat_arrays([pa.array(ends[1]), none(m)])})

    key = F.xxhash64("run", F.col("cell.i"), F.col("cell.j"))
    flat = rows.select(key.alias("cell"), F.col("cell.role").alias("role"), "run", "fp", "label", "n", "bitmap")
    return flat.groupBy(F.pmod("cell", F.lit(tasks)).alias("task")).applyInArrow(run, "run long, a long, b long").distinct()


def linked(found: DataFrame, sketches: DataFrame, fetch: Fetch, tokens_of: Tokens, p: LinkParameters) -> DataFrame:
    """(node, root) of the sets that link with another; ``found`` comes from ``runs``, stored, and ``sketches`` from
    ``by_node``, with all the sets in it (fp, n, bitmap)."""
    spark = found.sparkSession

    def fetched(*columns: DataFrame) -> DataFrame:
        want = columns[0]
        for x in columns[1:]:
            want = want.union(x)
        want = stored(want.toDF("fp").distinct())
        tokens = want.join(sketches.select("fp", "n"), "fp").agg(F.sum("n")).first()[0] or 0
        out = by_node(fetch(want), tokens, p)
        dropped(want)
        freed(spark)
        return out

    # a pair of these is tested or its ends have met already
    pairs = stored(close(found.where("run IS NULL").select("a", "b").distinct(), sketches, p))
    bodies = fetched(pairs.select("a"), pairs.select("b"))
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a"), F.max("n").alias("n")).select("a", "b", "n"))
    labels = connected(verified(first, bodies, tokens_of, p))
    freed(spark)
    ends = [labels.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab"]
    apart = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "n").join(first, ["a", "b"], "left_anti")
    offers, more, tested = p.offers, stored(apart), [pairs]
    holders, again = found.where("run IS NOT NULL").select("run", F.col("b").alias("fp")).distinct(), 0
    while True:
        if not more.isEmpty():
            joined = stored(verified(more, bodies, tokens_of, p))
            if not joined.isEmpty():
                labels = connected(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(joined))
            dropped(joined)
            freed(spark)
        if holders is None:
            dropped(bodies)
            return labels
        fresh = stored(across(holders, sketches, labels, offers, p))
        # only runs that held something back can offer more: what the others have is in ``fresh``, or tested
        runs_left = stored(holders.join(fresh.where("run IS NOT NULL").select("run"), "run", "left_semi"))
        untested = fresh.where("run IS NULL").select("a", "b")
        for t in tested:
            untested = untested.join(t.select("a", "b"), ["a", "b"], "left_anti")
        more = stored(untested.join(sketches.select(F.col("fp").alias("b"), "n"), "b").select("a", "b", "n"))
        tested.append(more)
        dropped(fresh)
        if not again and not more.isEmpty():  # later rounds draw on the runs that are left
            dropped(bodies)
            bodies = fetched(more.select("a"), more.select("b"), runs_left.select("fp"))
            again = 1
        holders = None if runs_left.isEmpty() else runs_left
        offers *= p.growth
