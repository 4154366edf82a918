"""Vectorised word splitting and n-gram hashing over many texts at once.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which on UTF-8 is the
pattern ``[^\\x20\\x09-\\x0D]+`` of the contracts. Hashes are 64-bit polynomial hashes over a seeded
random byte table, finished by a bit mixer, so that equal words hash alike in every task.
"""

from __future__ import annotations

import ctypes

import numpy as np

U64 = np.uint64
CHUNK = 1 << 20

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE2 = U64(0xD6E8FEB86659FD93)
_BASE3 = U64(0xA0761D6478BD642F)


def _inverse(x: np.uint64) -> np.uint64:
    y, m = int(x), 1 << 64
    return U64(pow(y, -1, m))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base):
        self.base, self.n = base, 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                one = np.ones(self.n, U64)
                up, down = one.copy(), one
                up[1:], down[1:] = self.base, _inverse(self.base)
                self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_P1, _P2, _P3 = _Powers(_BASE), _Powers(_BASE2), _Powers(_BASE3)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of data[start:end] for each span; spans are sorted and don't overlap. Long data go in chunks.
    table: a random 64-bit number for each value that the data may have."""
    out = np.empty(len(start), U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            lo = int(start[at])
            to = int(np.searchsorted(end, lo + CHUNK, "right"))
            to = max(to, at + 1)
            hi = int(end[to - 1])
            up, down = _P1.upto(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
            at = to
    return out


class Words:
    """The words of many texts: byte spans in `data`, hash and text number of each, and `first`, the
    number of each text's first word (with one entry past the end)."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, hashes: bool = True):
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        if lower:
            joined = joined.lower()  # bytes.lower changes A-Z alone
        data = np.frombuffer(joined, np.uint8)
        gap = _WS[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        offset = np.concatenate(([0], np.cumsum(sizes)))
        self.data, self.joined = data, joined
        self.first = np.searchsorted(self.start, offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = span_hashes(data, self.start, self.end) if hashes else None

    def grams(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each place where n words of one text follow, and those places. second: another 64 bits."""
        total = len(self.start)
        if total < n:
            return np.empty(0, U64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: total - n + 1])
        with np.errstate(over="ignore"):
            up, down = (_P3 if second else _P2).upto(total + 1)
            sums = np.zeros(total + 1, U64)
            np.cumsum(self.hash * up[:total], out=sums[1:])
            return mix((sums[at + n] - sums[at]) * down[at] + U64(n)), at


def batches(column, size: int = 1 << 20):
    """Slices (from, to) of an Arrow binary or string array, each of about `size` bytes or one value."""
    import pyarrow as pa

    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def free() -> None:
    """Gives the system back what Arrow and numpy have freed: their allocators keep it, and a Python worker lives on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def freeing(run):
    """run, a function for mapInArrow, with freed memory given back after each of its batches and at its end."""

    def each(rows):
        for batch in rows:
            yield batch
            free()

    def freed(rows):
        try:
            yield from run(each(rows))
        finally:
            free()

    return freed
