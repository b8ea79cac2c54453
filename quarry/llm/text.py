"""Vectorised text kernels over Arrow string columns (no Spark in here).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased.
Words are known by 64-bit hashes that numpy computes for a whole chunk at once:
a polynomial prefix sum modulo 2**64 over per-byte random values gives the hash
of any span by one subtraction and one multiplication, and a finaliser mixes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits; other bytes belong to words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}

#: Bytes of text that are worked on at once; a longer text comes alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix() made x from."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the next chunk unless a text was very long."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        found = {}
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, CHUNK * 3 // 2), base, np.uint64)
            steps[0] = 1
            found[name] = np.multiply.accumulate(steps)
        if n > CHUNK * 64:
            return found["up"][:n], found["down"][:n]
        _POWERS.update(found)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; whole texts only."""
    data, offs = raw(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1))
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """The words of a chunk: ``start``/``end`` byte spans, ``row`` (of the chunk), 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR):
        n = len(data)
        self.rows = len(offs) - 1
        self.data = LOWER[data]
        body = ~separator[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = body[:-1], body[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.start = np.flatnonzero(body & ~before)
        self.end = np.flatnonzero(body & ~after) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        up, down = _powers(n)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * up, out=self._sum[1:])
        self._down = down
        self.hash = self.span_hash(self.start, self.end)
        #: words of row r: first[r] to first[r + 1]
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal bytes give equal hashes anywhere."""
        if not len(start):
            return np.zeros(0, np.uint64)
        h = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


_LANE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of k words within a row."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h += hashes[j : j + m] * _LANE[j]
    at = np.flatnonzero(row[:m] == row[k - 1 :])
    return mix(h[at] ^ np.uint64(k)), at


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    h, at = grams(words.hash, words.row, k)
    where = np.searchsorted(at, words.first)
    out = []
    for r in range(words.rows):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= k:
            out.append(np.unique(h[where[r] : where[r + 1]]))
        elif b > a:
            with np.errstate(over="ignore"):
                x = (words.hash[a:b] * _LANE[: b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([x ^ np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end) the number of code points that start before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
