"""Packed blocks of sorted keys and numbers, and bit tables in front of keys."""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from quarry.llm.spark import arrow_map

#: Binary logarithm of the bits of a sieve.
SIEVE_BITS = 28


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers as a block: byte by byte, so that what sorted or small numbers share takes no room."""
    sizes = np.array([len(columns), *map(len, columns)], np.uint64).tobytes()
    return zstandard.compress(sizes + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    """The columns of a block, as uint64."""
    data = np.frombuffer(zstandard.decompress(block), np.uint8)
    n = int(data[:8].view(np.uint64)[0])
    ends = 8 + 8 * n + 8 * np.cumsum(data[8 : 8 + 8 * n].view(np.uint64)).astype(np.int64)
    return [np.ascontiguousarray(data[f:t].reshape(8, -1).T).reshape(-1).view(np.uint64) for f, t in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist())]


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, which pack smaller; np.cumsum() gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as a block."""
    return pack(steps(keys))


def unpack_keys(block: bytes) -> np.ndarray:
    return np.cumsum(unpack(block)[0], dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by sorting."""
    x = np.sort(x)
    return x[np.flatnonzero(np.r_[True, x[1:] != x[:-1]])] if len(x) else x


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts x, where in it equal numbers start, how many there are)."""
    order = np.argsort(x)
    y = x[order]
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]]) if len(y) else order
    return order, first, np.diff(np.r_[first, len(y)])


class Sieve:
    """A bit table in front of the keys (a) of blocks: what it rules out isn't there; what it lets pass is looked up."""

    def __init__(self, blocks: DataFrame):
        self.bits = None
        n = max(8, math.isqrt(blocks.rdd.getNumPartitions()))
        marked = arrow_map(blocks.select("a").coalesce(n), _mark, "bits binary").repartition(1)
        self.block = next((bytes(r[0]) for r in arrow_map(marked, _merge, "bits binary").collect()), None)

    def table(self) -> np.ndarray:
        """The bits; a task keeps them, and not their block."""
        if self.bits is None:
            self.bits = np.zeros(1 << SIEVE_BITS - 3, np.uint8) if self.block is None else np.frombuffer(zstandard.decompress(self.block), np.uint8)
            self.block = None
        return self.bits


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a sieve for each key."""
    return (h >> np.uint64(64 - SIEVE_BITS)).view(np.int64), (h << np.uint64(SIEVE_BITS) >> np.uint64(64 - SIEVE_BITS)).view(np.int64)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    out = (table[a >> 3] >> (a & 7).astype(np.uint8) & np.uint8(1)).view(bool)
    at = np.flatnonzero(out)
    b = b[at]
    out[at] = (table[b >> 3] >> (b & 7).astype(np.uint8) & np.uint8(1)).view(bool)
    return out


def _mark(batches):
    """One bit table of the task's keys."""
    table = None
    for batch in batches:
        table = np.zeros(1 << SIEVE_BITS - 3, np.uint8) if table is None else table
        for block in batch.column(0):
            for at in _bits(unpack_keys(block.as_py())):
                at = np.sort(at)
                first = np.flatnonzero(np.r_[True, at[1:] >> 3 != at[:-1] >> 3])
                table[at[first] >> 3] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)
    if table is not None:
        yield {"bits": [zstandard.compress(table, 1)]}


def _merge(batches):
    out = None
    for b in batches:
        for block in b.column(0):
            out = np.zeros(1 << SIEVE_BITS - 3, np.uint8) if out is None else out
            out |= np.frombuffer(zstandard.decompress(block.as_py()), np.uint8)
    if out is not None:
        yield {"bits": [zstandard.compress(out, 1)]}
