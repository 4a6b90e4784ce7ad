"""Vectorised word and n-gram hashing over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
#: ASCII white space: TAB to CR, and the space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
                x = np.full(size, _U(base), np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Words:
    """Words of some texts: ``hashes`` and byte spans in order, ``doc`` of each word, ``first`` word of each text (and the end)."""

    __slots__ = ("buf", "bounds", "doc", "ends", "first", "hashes", "starts")

    def __init__(self, texts: list[bytes], separator: np.ndarray = SPACE, lower: bool = False):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # one blank after each text keeps words of neighbours apart
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.buf = raw
        self.bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        gap = separator[raw]
        if not separator[32]:
            gap[self.bounds[1:] - 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        up, down = _power(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)))
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of n words within one text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = mix(h * _U(_PRIME) + self.hashes[at + k])
        return at, h


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place of a buffer on."""
    up, down = _power(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up[: len(buf)], dtype=np.uint64)))
        return mix((total[k:] - total[:-k]) * down[: len(buf) - k + 1])
