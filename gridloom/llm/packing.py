"""Sum-of-squares online packing of documents into token sequences.

A document is its token ids and id 0 at its end. Its full windows of `size` tokens are sequences of
their own; the remainder is placed online. Fill levels are steps of GRAIN tokens; with N[h] the number
of open windows of level h, the remainder goes to the level (or to a new window) that makes the sum of N[h]
squared smallest. A window of the last level is full: it is closed and leaves the sum; what it has too much, less
than GRAIN tokens, is cut off, and what it lacks is filled up with such cuttings of others. A remainder may also be
cut where it fills a window and the rest is placed by itself: that costs CUT besides, so it is done only
where windows of one level pile up that no whole remainder fits, and the open windows stay bounded by CUT
times the levels. Ties go to the fuller window. (With a level for each token, as the method is mostly put, a split's
thousands of remainders left hundreds of windows open at its end.)

Each task packs its own split with a level array of its own. At the end of a split the windows that are full
but for less than GRAIN tokens are filled up; then the pieces of the open windows are laid end to end and cut at
multiples of `size`, and the last stretch is cut into sequences whose lengths are powers of two, which need
no padding.

Ids come from a byte-level BPE vocabulary. A space or line feed between non-spaces always starts a new
pre-token, so texts without white space beside white space or at an end are cut there, and the different
chunks of about 2 MB of text are tokenised once, in one call; other texts are tokenised one by one. The pattern's
look ahead, which costs most of a search, is a cut before the last of several white spaces instead. A text is
cut at the vocabulary's added tokens first, each of which is its own id. So the ids equal those of the `tokenizers` library over the same vocabulary without
special tokens added; tests hold this over all documents of a table and over odd and random texts.

Sequence ids are the split's number times 2^32 plus a count: unique, and the same when a task runs
again over the same split.

Defined cases: a null or empty text is the one id 0. A null doc_id is kept. Rows that repeat are
packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

SIZE = 1024
#: Tokens of a step of the level array.
GRAIN = 32
#: What a cut costs, in squared counts.
CUT = 64
#: Bytes of text whose ids are made at once; a longer document is taken by itself.
GROUP = 1 << 21
#: White space as the vocabulary's pattern has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern's look ahead, which leaves the last of several white spaces to the word after them; and where it does.
AHEAD = r"\s+(?!\S)|"
LAST_SPACE = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(json_path, encoding="utf-8") as f:
            added = {x["content"]: int(x["id"]) for x in json.load(f).get("added_tokens") or []}
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        names = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.cuts = re.compile(names) if added else None
        self.odd = "|".join([f"[{SPACE}]{{2}}|^[{SPACE}]|[{SPACE}]$", *[names] * bool(added)])

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN.replace(AHEAD, ""), mergeable_ranks=ranks, special_tokens={})
        self.ahead = AHEAD in public_tokenizers.PATTERN
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def encode(self, text: str) -> bytes:
        if self.cuts and self.cuts.search(text):
            out, last = [], 0
            for m in self.cuts.finditer(text):
                out += [self.plain(text[last : m.start()]), self.added[m[0]]]
                last = m.end()
            return b"".join([*out, self.plain(text[last:])])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        return b"".join(np.array(self.bpe.encode_ordinary(x), "<u4").tobytes() for x in (LAST_SPACE.split(text) if self.ahead else [text]))

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, null as empty. Different chunks are encoded once, in one call."""
        odd = pc.fill_null(pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(texts, "")), True).to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~odd)
        out = [b""] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self.encode(texts[int(i)].as_py() or "")
        if not len(even):
            return out
        # a chunk keeps the line feed before it and loses the space; no text has white space beside white space or at an end
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = split.flatten().dictionary_encode()
        chunks, heads = found.dictionary, pc.binary_join_element_wise("", pc.list_element(split, 0), "\n")  # a text's first chunk has no space: a line feed for it
        both = pa.concat_arrays([chunks, heads])
        sizes = pc.binary_length(both).to_numpy() + 1 - pc.starts_with(both, "\n").to_numpy(zero_copy_only=False)
        text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(both)], both), " ")[0].as_py()
        text = text.replace(" \n", "\n")
        ids = np.array(self.bpe.encode_ordinary(text), "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1
        begins = np.concatenate([[0], ends[:-1]])
        begins[len(chunks) :] += 1  # without that line feed
        own = found.indices.to_numpy().copy()
        own[first[:-1]] = len(chunks) + np.arange(len(even))
        counts = (ends - begins)[own]
        to = np.concatenate([[0], np.cumsum(counts)])
        all_ids = ids[np.repeat(begins[own] - to[:-1], counts) + np.arange(to[-1])]
        for i, lo, hi in zip(even.tolist(), to[first[:-1]].tolist(), to[first[1:]].tolist()):
            out[i] = all_ids[lo:hi].tobytes()
        return out


@functools.lru_cache(1)
def _ids(ranks_path: str, json_path: str) -> Ids:
    """The tables of a worker, kept for its next tasks."""
    return Ids(ranks_path, json_path)


class Packer:
    """Pieces are [doc_id, start, ids as bytes, tokens of the document]."""

    def __init__(self, size: int = SIZE, first: int = 0, grain: int = GRAIN, cut: float = CUT):
        self.size, self.next, self.grain, self.cut = size, first, min(grain, size), cut
        self.full = size // self.grain - 1 if self.grain > 1 else size  # the level at which a window is full
        self.levels = np.zeros(self.full)
        self.fills = np.zeros(self.full, np.int64)  # of the window that is next at a level
        self.at: list[list[list[list]]] = [[] for _ in range(self.full)]
        self.lacking: list[list[list]] = []  # full windows that wait for cuttings
        self.cuttings: list[list] = []
        self.rows: list[tuple] = []
        #: Sequences of whole windows, of placement, and of the end.
        self.closed = {"whole": 0, "placed": 0, "end": 0}

    def close(self, pieces: list[list], how: str) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1
        self.closed[how] += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.size
        for lo in range(0, len(ids) - step + 1, step):
            self.close([[doc_id, lo // 4, ids[lo : lo + step], total]], "whole")
        a = total % self.size
        if a:
            self.place([doc_id, total - a, ids[-4 * a :], total])

    def best(self, a: int) -> tuple[int | None, float]:
        """The level whose next window takes `a` tokens at the least sum of squares, or None for a new one; and by
        how much the sum grows, a cut's cost included."""
        n, g, size = self.levels, self.grain, self.size
        new = min(a // g, self.full)
        least, where = 2 * n[new] + 1 if new < self.full else 0.0, None
        there = np.flatnonzero(n)[::-1]  # fuller windows first
        if len(there):
            after = self.fills[there] + a
            to = np.minimum(after // g, self.full)
            over = after - size
            leaves = 1 - 2 * n[there]
            cost = np.where(to == there, 0.0, np.where(to < self.full, leaves + 2 * n[np.minimum(to, self.full - 1)] + 1, leaves))
            rest = np.clip(over, 0, size - 1) // g
            cost = np.where(over >= g, leaves + self.cut + np.where(rest < self.full, 2 * n[np.minimum(rest, self.full - 1)] + 1, 0), cost)
            i = int(cost.argmin())
            if cost[i] <= least:
                least, where = float(cost[i]), int(there[i])
        return where, least

    def place(self, piece: list) -> None:
        while piece:
            a = len(piece[2]) // 4
            level, _ = self.best(a)
            window, fill = [], 0
            if level is not None:
                window, fill = self.at[level].pop(), int(self.fills[level])
                self.levels[level] -= 1
                self.fills[level] = self.filled(self.at[level][-1]) if self.at[level] else 0
            rest = None
            if fill + a > self.size:
                piece, rest = self.parted(piece, self.size - fill)
            window.append(piece)
            to = min((fill + len(piece[2]) // 4) // self.grain, self.full)
            if to < self.full:
                self.at[to].append(window)
                self.levels[to] += 1
                self.fills[to] = fill + a
            else:
                self.lacking.append(window)
            if rest and len(rest[2]) < 4 * self.grain:
                self.cuttings.append(rest)
                rest = None
            self.fill_up()
            piece = rest

    @staticmethod
    def filled(window: list[list]) -> int:
        return sum(len(p[2]) for p in window) // 4

    @staticmethod
    def parted(piece: list, n: int) -> tuple[list, list | None]:
        """The first n tokens of a piece, and the rest."""
        if n >= len(piece[2]) // 4:
            return piece, None
        return [piece[0], piece[1], piece[2][: 4 * n], piece[3]], [piece[0], piece[1] + n, piece[2][4 * n :], piece[3]]

    def fill_up(self) -> None:
        """Closes full windows, with cuttings for what they lack, as long as there are some."""
        while self.lacking:
            gap = self.size - self.filled(self.lacking[-1])
            if gap and not self.cuttings:
                return
            if gap:
                head, rest = self.parted(self.cuttings.pop(), gap)
                self.lacking[-1].append(head)
                if rest:
                    self.cuttings.append(rest)
            else:
                self.close(self.lacking.pop(), "placed")

    def settle(self) -> None:
        """Closes everything: what full windows lack is cut from the emptiest others, then those are laid end to end."""
        pieces = [p for level in reversed(self.at) for w in level for p in w]
        self.at = [[] for _ in range(self.full)]
        self.levels[:], self.fills[:] = 0, 0
        while self.lacking and (self.cuttings or pieces):
            if not self.cuttings:
                self.cuttings.append(pieces.pop())
            self.fill_up()
        pieces += self.cuttings + [p for w in self.lacking for p in w]
        self.lacking, self.cuttings = [], []
        left = self.filled(pieces)
        pieces.reverse()  # taken from the end
        while left:
            fill = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= fill
            window = []
            while fill:
                head, rest = self.parted(pieces.pop(), fill)
                window.append(head)
                fill -= len(head[2]) // 4
                if rest:
                    pieces.append(rest)
            self.close(window, "end")

    def taken(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in COLUMNS.split(", ")])


def _pack(size: int, ranks_path: str, json_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = _ids(ranks_path, json_path), Packer(size, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids, texts = batch.columns
            for c in tv.chunks(texts, GROUP):
                for doc_id, own in zip(doc_ids.slice(c.lo, c.n).to_pylist(), ids.many(texts.slice(c.lo, c.n))):
                    packer.add(doc_id, own + b"\0\0\0\0")
                yield packer.taken()
        packer.settle()
        yield packer.taken()

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(tv.tidy(_pack(size, str(ranks_path), str(json_path))), COLUMNS)
