"""Vectorised words, shingles and hashes over Arrow text columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Whole chunks of a batch are handled at once with NumPy: no Python runs per word.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back: it waits for further tasks with all that its last one had freed."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)

    return tidied

#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK = 1 << 20
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    z = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _table(lower: bool) -> np.ndarray:
    codes = _LOWER if lower else np.arange(256, dtype=np.uint8)
    t = mix(codes.astype(U) + U(1), 7)
    t[_SPACE] = 0
    return t


_BYTE = {True: _table(True), False: _table(False)}
_POWER = mix(np.arange(4096, dtype=U), 11) | U(1)
_PLACE = mix(np.arange(64, dtype=U), 13) | U(1)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, off


class Chunk:
    """Some documents of a batch: rows lo..hi, their bytes, and offsets from 0."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.bytes = data[off[lo] : off[hi]]
        self.off = off[lo : hi + 1] - off[lo]
        self.n = hi - lo


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(data, off, lo, hi)
        lo = hi


class Words:
    """Where words start and end in a chunk; first[d]..first[d+1] are those of document d."""

    def __init__(self, c: Chunk):
        n = len(c.bytes)
        self.chunk = c
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(c.n + 1, np.int64)
            return
        solid = ~_SPACE[c.bytes]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = solid[:-1]
        heads = c.off[:-1]
        before[heads[heads < n]] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        tails = c.off[1:]
        after[tails[tails > 0] - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, c.off)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.count())

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; A-Z fold to a-z if lower."""
        if len(self.start) == 0:
            return np.zeros(0, U)
        b = self.chunk.bytes
        at = np.arange(len(b), dtype=np.int32)
        at[self.start[0] :] -= np.repeat(self.start.astype(np.int32), np.diff(self.start, append=len(b)))
        v = _BYTE[lower][b]
        v *= _POWER[at & np.int32(4095)]
        return mix(np.add.reduceat(v, self.start), 17)


def grams(word: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place of the first word) of each k-word gram, in order. With short, a
    document of 1 to k-1 words gives its whole sequence as one gram."""
    count = np.diff(first)
    full = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), full)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + first[:-1][doc] if len(doc) else np.zeros(0, np.int64)
    h = np.zeros(len(doc), U)
    for j in range(k):
        h += word[start + j] * _PLACE[j]
    if short and (less := np.flatnonzero((count > 0) & (count < k))).size:
        hs = np.array([sum((int(word[first[d] + j]) * int(_PLACE[j]) for j in range(count[d])), int(count[d])) & 0xFFFFFFFFFFFFFFFF for d in less], U)
        doc, start, h = np.concatenate([doc, less]), np.concatenate([start, first[less]]), np.concatenate([h, mix(hs, 19)])
        order = np.argsort(doc, kind="stable")
        doc, start, h = doc[order], start[order], h[order]
    return mix(h, 23), doc, start


def sets(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, ascending within it, and the documents' bounds."""
    first = np.searchsorted(doc, np.arange(n + 1))
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    if len(h):
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(n + 1))


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each document's stretch; 0 for an empty stretch."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if full.size:
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def held_out(doc_id: int | None) -> bool:
    """Whether a document belongs to the fold that no model learns from."""
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
