"""Byte-level BPE: encoding and decoding of whole texts over a public table of ranks.

A text is cut by the vocabulary's pattern. The pieces of chunks that a task hasn't met yet are sorted into
buckets of widths and laid into padded matrices of ids, a row for each piece. In each round every row that still has a
pair in the table merges its leftmost pair of least rank: the ranks of neighbours lie in a second
matrix, of which only the two beside a merge are looked up again in a hash table of pairs. A merge takes
one id out of every row, so compaction keeps the matrix full and one column narrower; rows without a
pair leave it. Pieces of more than WIDEST bytes would cost their squared length that way; they are merged
in the same order by a heap of pairs, in n log n.

A piece that is in the vocabulary is one id, as in the `tiktoken` library. Decoding joins the
bytes of the ids. Tests hold ids equal to the library's over random and odd texts of all of Unicode.

Memory of a task: the table of pairs (some 10 MB), the ids of KEPT chunks, matrices of CELLS cells, and
the batch of texts at hand.

Defined cases: a null text is encoded as the empty one: no ids. Bytes that aren't UTF-8 count as U+FFFD.
Null and repeated ids of rows are kept, each row by itself; other columns are ignored; an empty table
gives an empty result. A text has no length limit.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks whose ids a task keeps, at most (some 200 bytes each).
KEPT = 800_000
#: Bytes of a piece that goes into a matrix, at most.
WIDEST = 256
#: Cells of a matrix, about.
CELLS = 1 << 20

NONE = np.int32(np.iinfo(np.int32).max)  # no pair: ranks above all others
PAD = np.int32(-1)


class Pairs:
    """Rank of the joint of two ids, by open addressing: a pair lies at the first free place after its own."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is none, or one side is PAD."""
        keys = (a.astype(np.int64) << 32) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        left = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Ranks of byte strings; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(pattern).findall
        self.spaced = pattern == _args(None, None)[1]  # a space before another character starts a piece
        self.strings = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.strings[v] = k
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        found = [(x, y, r) for k, r in self.ranks.items() for i in range(1, len(k)) if (x := self.ranks.get(k[:i])) is not None and (y := self.ranks.get(k[i:])) is not None]
        a, b, r = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        self.pairs = Pairs((a << 32) | b, r.astype(np.int32))
        self.kept: dict[str | tuple[str], bytes] = {}

    def rounds(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of rows of at most width bytes, as little-endian unsigned 32-bit bytes."""
        size = np.array([len(x) for x in rows])
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], PAD).astype(np.int32)
        rank = self.pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        place, out = np.arange(len(rows)), [b""] * len(rows)
        while len(ids):
            w = ids.shape[1]
            if w > 1:
                best = rank.argmin(axis=1)  # the leftmost of equals
                least = rank[np.arange(len(ids)), best]
                done = least == NONE
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                over = ids[done]
                n = (over >= 0).sum(axis=1)
                flat, step = over.astype("<u4").tobytes(), 4 * w
                for i, (p, k) in enumerate(zip(place[done].tolist(), n.tolist())):
                    out[p] = flat[i * step : i * step + 4 * k]
                if done.all():
                    break
                go = ~done
                ids, rank, place, best, least = ids[go], rank[go], place[go], best[go], least[go]
            row = np.arange(len(ids))
            ids[row, best] = least
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(row), w - 1)
            keep = np.ones(rank.shape, bool)
            keep[row, best] = False
            rank = rank[keep].reshape(len(row), w - 2)
            if w > 2:  # the pairs on both sides of the merged id
                left, right = best > 0, best < w - 2
                rank[row[left], best[left] - 1] = self.pairs.of(ids[row[left], best[left] - 1], least[left])
                rank[row[right], best[right]] = self.pairs.of(least[right], ids[row[right], best[right] + 1])
        return out

    def long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length: pairs from a heap by rank and place, neighbours by links."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        part = [self.strings[i] for i in ids]
        heap = [(r, i) for i in range(n - 1) if (r := get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or get(part[i] + part[j]) != r:
                continue  # one side has merged since
            part[i], part[j] = self.strings[r], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (x, h))
        return np.array([get(x) for x in part if x is not None], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces."""
        out: dict[str, bytes] = {}
        buckets: dict[int, tuple[list[str], list[bytes]]] = {}
        get = self.ranks.get
        for p in pieces:
            raw = p.encode()
            whole = get(raw)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
                continue
            n = len(raw)
            if n > WIDEST:
                out[p] = self.long(raw)
                continue
            names, rows = buckets.setdefault(n + n % 2 if n <= 24 else -(-n // 32) * 32, ([], []))
            names.append(p)
            rows.append(raw)
        for width, (names, rows) in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                out.update(zip(names[i : i + step], self.rounds(rows[i : i + step], width)))
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes. Texts are cut and learned together
        until they have STRETCH characters."""
        held, n = [], 0
        for t in texts:
            held.append(t)
            n += len(t)
            if n >= STRETCH:
                yield from self._together(held)
                held, n = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """Chunks between single spaces are looked up by themselves where the pattern allows it; the
        start of a text, or all of one with other white space about its spaces, is a tuple."""
        cut = [[(h,), *c] for h, *c in (t.split(" ") for t in texts)] if self.spaced else [[(t,)] for t in texts]
        new = set().union(*cut).difference(self.kept)
        odd = {c for c in new if type(c) is str and (not c or c[0].isspace() or c[-1].isspace())}
        if odd or any(c[0][0][-1:].isspace() for c in cut):
            cut = [[(t,)] if len(c) > 1 and (c[0][0][-1:].isspace() or not odd.isdisjoint(c)) else c for t, c in zip(texts, cut)]
            new = set().union(*cut).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = set().union(*cut)
        pieces = {c: self.pieces(c[0] if type(c) is tuple else " " + c) for c in new}
        ids = self.learn(set().union(*pieces.values())).__getitem__
        found = {c: b"".join(map(ids, p)) for c, p in pieces.items()}
        starts = {c: x for c, x in found.items() if type(c) is tuple}  # not kept: some are whole texts
        self.kept.update((c, x) for c, x in found.items() if type(c) is str)
        get = self.kept.__getitem__
        for (h, *c) in cut:
            yield starts[h] + b"".join(map(get, c))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Characters of texts that are cut together.
STRETCH = 1 << 20


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker, which serves many tasks."""
    return Vocabulary(path, pattern)


def _texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") if x else "" for x in column.to_pylist()]


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            ids = list(v.encode(_texts(batch.column(1))))
            at = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], names=["doc_id", "ids"])

    return run


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            out = [None if x is None else v.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return run


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in v.encode(_texts(batch.column(1))):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _args(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return str(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return _rows(docs, key, text).mapInArrow(_encoded(*_args(path, pattern)), "doc_id long, ids array<int>")


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of every row of ids; null ids give null."""
    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(_decoded(*_args(path, pattern)), "doc_id long, bytes binary")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and, after decoding the ids, decoded_sha256; a row for each row."""
    return _rows(docs, key, text).mapInArrow(_digests(*_args(path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
