"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one per code point; an agenda of adjacent pairs, ordered by the score of the piece that they make
(then leftmost), is merged from the top until no pair makes a piece. Where no piece of the vocabulary has the word mark
after another character, merges can't cross a word's start, so each word is encoded once and remembered. Every word
that a task meets first, long ones in each slice, and of each slice of an Arrow batch the first four whole texts of up to
3,000 code points, are checked against the sentencepiece library, and every text's decoding is.

A null or empty text has no ids and decodes to the empty text. Repeated rows and null doc_ids are carried along. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, text_slices

MARK = "▁"
_SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*")


class Mismatch(ValueError):
    """This module and the sentencepiece library disagree."""


class Coder:
    """Encodes and decodes with the vocabulary of a model file.

    Words are remembered by number: their ids stand in one array of 32-bit integers, so that a text is put together from
    its words' numbers in a few array operations. Once that takes ``MOST_BYTES`` (about), all is forgotten.
    """

    MOST_BYTES = 128 << 20
    #: Words this long (in code points) have a heap each, and are not remembered.
    LONGEST = 48

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        odd = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                odd.append(sp.is_unused(i))
                self.pieces[piece] = (-sp.get_score(i), i)
                self.surface.append(piece.replace(MARK, " ").encode())
        if len(self.bytes) != 256 or any(odd) or sp.normalize("  ﬁ ") != f"{MARK}{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("only vocabularies with byte fallback, the identity normaliser and a leading mark are supported")
        self._pairs()
        self.by_word = not any(MARK in x.lstrip(MARK) for x in self.pieces)
        size = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self.surface_start, self.surface_size = np.cumsum(size) - size, size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        # each id in decimal and a comma, in eight bytes; zeros pad
        self.decimal = np.frombuffer(b"".join(b"%d," % i + bytes(7 - len(str(i))) for i in range(len(self.surface))), np.uint8).reshape(-1, 8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 12, np.int32)
        self.starts = np.zeros((1 << 10) + 1, np.int64)
        self.words = self.held = 0

    def _pairs(self) -> None:
        """Sorted keys of all pairs of symbols that make a piece, with the place of that piece in score order and its id."""
        self.symbol: dict[str, int] = {}
        for piece, (_, i) in self.pieces.items():
            if len(piece) == 1:
                self.symbol[piece] = i
        size, rows = len(self.surface), []
        for piece, (cost, i) in self.pieces.items():
            for k in range(1, len(piece)):
                ends = []
                for part in (piece[:k], piece[k:]):
                    known = self.pieces.get(part)
                    if known:
                        ends.append(known[1])
                    elif len(part) == 1:  # a character that is no piece itself
                        ends.append(self.symbol.setdefault(part, size + len(self.symbol)))
                if len(ends) == 2:
                    rows.append(((ends[0] << 32) | ends[1], cost, i))
        keys = np.array([r[0] for r in rows], np.int64)
        # the last entry stands for a pair that makes no piece
        self.pair_key = np.append(keys, -1)
        self.pair_cost = np.array([r[1] for r in rows] + [np.inf], np.float32)
        self.pair_id = np.array([r[2] for r in rows] + [-1], np.int64)
        # open addressing, a quarter full at most
        self.shift = 64 - max(8, int(np.ceil(np.log2(4 * len(rows) + 1))))
        self.slots = np.full(1 << (64 - self.shift), len(rows), np.int32)
        home, left = self._home(keys), np.arange(len(rows))
        while len(left):
            free = self.slots[home[left]] == len(rows)
            first = left[free][np.unique(home[left[free]], return_index=True)[1]]
            self.slots[home[first]] = first
            left = np.setdiff1d(left, first)
            home[left] = (home[left] + 1) & (len(self.slots) - 1)
        self.by_point = np.full(0x110000, self.NO_SYMBOL, np.int64)
        self.by_point[[ord(c) for c in self.symbol]] = list(self.symbol.values())

    #: A symbol that makes no piece with any other.
    NO_SYMBOL = 1 << 30

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in the table of pairs."""
        key = (a << 32) | b
        home = self._home(key)
        out = self.slots[home]
        none = len(self.pair_key) - 1
        left = np.flatnonzero((out != none) & (self.pair_key[out] != key))
        while len(left):
            home[left] = (home[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[home[left]]
            left = left[(out[left] != none) & (self.pair_key[out[left]] != key[left])]
        return out

    def merge_many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short segments of one length, all at once, one after another, and the number of each one's.

        Each segment keeps its agenda in a row of costs. A round pops every row's top and merges it, so rows stay equally
        long; a segment whose agenda is empty leaves.
        """
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).reshape(len(segments), -1)
        sym, who = self.by_point[points], np.arange(len(segments))
        # a symbol that is no piece is written in bytes at the end, so its code point must come along
        sym = np.where(sym >= len(self.surface), (points.astype(np.int64) << 32) | sym, sym)
        pair = self._look(sym[:, :-1].ravel() & 0xFFFFFFFF, sym[:, 1:].ravel() & 0xFFFFFFFF).reshape(len(segments), -1)
        cost = self.pair_cost[pair]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            n, wide = sym.shape
            if wide == 1:
                done.append((who, sym))
                break
            top = cost.argmin(1)
            go = np.isfinite(cost[np.arange(n), top])
            if not go.all():
                done.append((who[~go], sym[~go]))
                who, sym, pair, cost, top = who[go], sym[go], pair[go], cost[go], top[go]
                n = len(who)
                if not n:
                    break
            rows = np.arange(n)
            made = self.pair_id[pair[rows, top]]
            keep = np.ones((n, wide), bool)
            keep[rows, top + 1] = False
            sym = sym[keep].reshape(n, wide - 1)
            sym[rows, top] = made
            keep = np.ones((n, wide - 1), bool)
            keep[rows, top] = False
            pair, cost = pair[keep].reshape(n, wide - 2), cost[keep].reshape(n, wide - 2)
            for side, ok in ((-1, top > 0), (0, top < wide - 2)):
                r, c = rows[ok], top[ok] + side
                new = self._look(sym[r, c] & 0xFFFFFFFF, sym[r, c + 1] & 0xFFFFFFFF)
                pair[r, c], cost[r, c] = new, self.pair_cost[new]
        counts = np.zeros(len(segments), np.int64)
        for w, x in done:
            counts[w] = x.shape[1]
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for w, x in done:
            out[starts[w][:, None] + np.arange(x.shape[1])] = x
        odd = np.flatnonzero(out >= len(self.surface))
        if len(odd):
            spelt = [[self.bytes[b] for b in chr(int(x) >> 32).encode()] for x in out[odd]]
            owner = np.repeat(np.arange(len(segments)), counts)
            out = np.insert(out, np.repeat(odd + 1, [len(x) - 1 for x in spelt]), [i for x in spelt for i in x[1:]])
            shift = np.cumsum([0, *(len(x) - 1 for x in spelt[:-1])])
            out[odd + shift] = [x[0] for x in spelt]
            counts += np.bincount(owner[odd], weights=[len(x) - 1 for x in spelt], minlength=len(segments)).astype(np.int64)
        return out.astype(np.int32), counts

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment of any length; its agenda is a heap."""
        out: list[int] = []
        for x in self._heap(list(segment)):
            found = self.pieces.get(x)
            if found is None:
                out.extend(self.bytes[b] for b in x.encode())
            else:
                out.append(found[1])
        return out

    def _heap(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pieces.get
        agenda = [(f[0], i, i + 1, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (f := get(a + b))]
        heapq.heapify(agenda)
        alive = [True] * n
        while agenda:
            _, i, j, made = heapq.heappop(agenda)
            if not alive[i] or j >= n or not alive[j] or after[i] != j or len(parts[i]) + len(parts[j]) != len(made):
                continue
            parts[i], alive[j], k = made, False, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if f := get(made + parts[k]):
                    heapq.heappush(agenda, (f[0], i, k, made + parts[k]))
            if (h := before[i]) >= 0 and (f := get(parts[h] + made)):
                heapq.heappush(agenda, (f[0], h, i, parts[h] + made))
        return [x for x, ok in zip(parts, alive, strict=True) if ok]

    def keys(self, text: str) -> list[str]:
        """The words of a text: each stands for the mark and itself."""
        if not text:
            return []
        keys = text.split(" ")
        if "" in keys or MARK in text:
            keys = [x[1:] for x in _SEGMENTS.findall(MARK + text.replace(" ", MARK))]
        return keys

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Appends words' ids; gives the first one's number."""
        first, n = self.words, len(counts)
        begin = int(self.starts[first])
        end = begin + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.ids[begin:end] = ids
        self.starts[first + 1 : first + n + 1] = begin + np.cumsum(counts)
        self.words += n
        return first

    def _checked(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Raises if the library encodes any of the words otherwise."""
        theirs = self.library.encode(words, num_threads=1)
        if "" in words:  # the library drops a text's only mark
            theirs = [x if k else self.merge(MARK) for k, x in zip(words, theirs, strict=True)]
        if not np.array_equal(np.fromiter(map(len, theirs), np.int64, len(theirs)), counts) or not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int32, int(counts.sum())), ids):
            cut = np.concatenate(([0], np.cumsum(counts)))
            k, x, y = next((k, ids[i:j].tolist(), y) for k, i, j, y in zip(words, cut, cut[1:], theirs, strict=False) if ids[i:j].tolist() != y)
            raise Mismatch(f"{k[:200]!r}: {x[:200]} here, {y[:200]} by the library")

    def prepare(self, keys: set[str]) -> dict[str, int]:
        """Numbers of all the words: of remembered ones, and of the others, merged together and checked against the library."""
        if self.held > self.MOST_BYTES:
            self.forget()
        number = self.number
        by_size: dict[int, list[str]] = {}
        for k in keys:
            if k not in number:
                by_size.setdefault(min(len(k), self.LONGEST), []).append(k)
        extra: dict[str, int] = {}
        for size, words in by_size.items():
            if size < self.LONGEST:
                ids, counts = self.merge_many([MARK + k for k in words])
            else:
                found = [self.merge(MARK + k) for k in words]
                ids, counts = np.array([i for x in found for i in x], np.int32), np.fromiter(map(len, found), np.int64, len(found))
            self._checked(words, ids, counts)
            first = self._add(ids, counts)
            (number if size < self.LONGEST else extra).update(zip(words, range(first, first + len(words)), strict=True))
            self.held += 4 * len(ids) + len(words) * (4 * size + 160)
        return {**number, **extra} if extra else number

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the end)."""
        if self.by_word:
            keys = [self.keys(x) for x in texts]
            known = self.prepare(set().union(*keys))
            words = np.fromiter((known[k] for x in keys for k in x), np.int64, sum(map(len, keys)))
            per = np.fromiter(map(len, keys), np.int64, len(keys))
        else:
            found = [self.merge(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
            first = self._add(np.array([i for x in found for i in x], np.int32), np.fromiter(map(len, found), np.int64, len(found)))
            words, per = np.arange(first, first + len(texts)), np.ones(len(texts), np.int64)
            self.held += 4 * sum(map(len, found))
        size = self.starts[words + 1] - self.starts[words]
        ids = self.ids[_spread(self.starts[words], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        if not self.by_word and self.held > self.MOST_BYTES:
            self.forget()
        return ids, ends[np.concatenate(([0], np.cumsum(per)))]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decimals(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        wide = self.decimal[ids]
        full = wide != 0
        flat = wide[full].tobytes()
        ends = np.concatenate(([0], np.cumsum(full.sum(1))))[cut].tolist()
        return [flat[i : j - 1] if j > i else b"" for i, j in zip(ends, ends[1:], strict=False)]

    def decode_many(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        size = self.surface_size[ids]
        flat = self.surface_bytes[_spread(self.surface_start[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[cut].tolist()
        out = [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return [x[x[:1] == b" " :].decode("utf-8", "replace") for x in out]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def _spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - starts, size)


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One for each Python worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


#: Text bytes of a slice; so many of its texts of up to CHECK_WHOLE code points are checked whole against the library.
SLICE, CHECKED, CHECK_WHOLE = 1 << 20, 4, 3_000


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
    """Each slice with the ids of its texts, one after another, where each text's begin, and the decoded texts."""
    code = coder(path)
    for b in text_slices(batches, most=SLICE):
        texts = [x or "" for x in b.column("text").to_pylist()]
        ids, cut = code.encode_many(texts)
        own = [ids[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)]
        whole = [i for i, x in enumerate(texts) if len(x) <= CHECK_WHOLE][:CHECKED] if code.by_word else range(len(texts))
        for i in whole:
            if code.library.encode(texts[i]) != own[i]:
                raise Mismatch(f"a whole text: {texts[i][:200]!r}")
        decoded = code.library.decode(own, num_threads=1)
        for x, mine, theirs in zip(texts, code.decode_many(ids, cut), decoded, strict=True):
            if mine != theirs:
                raise Mismatch(f"the decoding of {x[:200]!r}")
        yield b, ids, cut, decoded


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _lists(ids: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, cut, decoded in encoded(batches, path):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": _lists(ids, cut), "decoded": pa.array(decoded, pa.string())})

    return only(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, cut, decoded in encoded(batches, path):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(np.diff(cut)), "ids_sha256": pa.array(map(digest, coder(path).decimals(ids, cut)), pa.string()), "decoded_sha256": pa.array([digest(x.encode()) for x in decoded], pa.string())})

    return only(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document: what a training run reads, and a proof of its round trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, cut, decoded in encoded(batches, path):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(np.diff(cut)), "ids": _lists(ids, cut), "decoded_sha256": pa.array([digest(x.encode()) for x in decoded], pa.string())})

    return only(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
