"""Word and word-sequence hashes of many texts at once, in numpy, inside a task.

Words are runs of anything but the six ASCII white-space characters. A word's hash is a polynomial modulo
2**64 over fixed random values of its UTF-8 bytes, mixed; a sequence's hash is one over the hashes of its words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = 0x9E3779B97F4A7C15  # odd multipliers of the two polynomials
_WORD = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(2)
def _values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.bases = [base, pow(base, -1, 1 << 64)]
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]), 1 << 16)
            self.tables = []
            for b in self.bases:
                steps = np.full(size, _U(b))
                steps[0] = 1
                self.tables.append(np.cumprod(steps))
        return self.tables[0][:n], self.tables[1][:n]


_POWERS = {b: _Powers(b) for b in (_BYTE, _WORD)}


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS[base].upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def word_hashes(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, bounds): text i has the words bounds[i]:bounds[i+1]."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *coded, b""]), np.uint8)
    space = _SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    sums, down = _prefix(_values(lower)[raw], _BYTE)
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    at = np.cumsum([0, *(len(c) + 1 for c in coded)])
    return hashes, np.searchsorted(starts, at)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Clash(Exception):
    """Different pieces share a hash."""


def told_apart(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces that cover raw, each from one start to the next: the hashes of the different ones, in order, where
    one of each stands, its size, and which of them every piece is. Their bytes confirm it, or Clash is raised."""
    sizes = np.diff(np.append(starts, len(raw)))
    sums, down = _prefix(_values(False)[raw], _BYTE)
    every = mixed((sums[starts + sizes] - sums[starts]) * down[starts], 3)
    hashes, one, which = np.unique(every, return_index=True, return_inverse=True)
    first, size = starts[one], sizes[one]
    if (size[which] != sizes).any() or (raw[ranges(first[which], sizes)] != raw).any():
        raise Clash
    return hashes, first, size, which


class Known:
    """Pieces that are known, in arrays: their hashes in order, where each one's bytes lie, and columns of numbers."""

    def __init__(self, *columns: str) -> None:
        self.columns = ("at", "size", *columns)
        self.hash, self.raw = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        for name in self.columns:
            setattr(self, name, np.zeros(0, np.int64))

    def find(self, hashes: np.ndarray, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pieces are known, and their places here); raises Clash if another piece has a hash."""
        if not len(self.hash):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        spot = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        old = self.hash[spot] == hashes
        at = spot[old]
        if (self.size[at] != size[old]).any() or (self.raw[ranges(self.at[at], size[old])] != raw[ranges(first[old], size[old])]).any():
            raise Clash
        return old, at

    def add(self, hashes: np.ndarray, pieces: list[bytes], **columns: np.ndarray) -> None:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(np.concatenate([self.hash, hashes]), kind="stable")
        self.hash = np.concatenate([self.hash, hashes])[order]
        for name, values in ({"at": len(self.raw) + np.cumsum(size) - size, "size": size} | columns).items():
            setattr(self, name, np.concatenate([getattr(self, name), values])[order])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)])

    def keep(self, on: np.ndarray) -> None:
        self.raw = self.raw[ranges(self.at[on], self.size[on])]
        self.hash = self.hash[on]
        for name in self.columns:
            setattr(self, name, getattr(self, name)[on])
        self.at = np.cumsum(self.size) - self.size


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words (fewer than n words: none)."""
    if n <= 0 or len(words) < n:
        return np.zeros(0, np.uint64)
    sums, down = _prefix(words, _WORD)
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1], n)


def shingle_sets(texts: list[str], n: int, lower: bool = True) -> list[np.ndarray]:
    """Each text's distinct shingles of n words, as sorted hashes; of fewer words, the whole sequence as one."""
    words, bounds = word_hashes(texts, lower)
    every = sequence_hashes(words, n)  # those that run over a text's end are not picked below
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        else:
            out.append(sequence_hashes(words[a:b], b - a))
    return out
