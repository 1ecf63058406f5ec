"""Byte-pair encoding in the core: the tokenizer of a model, and documents as token rows.

A tokenizer has ranks of byte strings, a pattern that cuts a text into pieces, and special tokens whose
ids follow the ranks. A piece's bytes are merged by a heap of neighbouring pairs, least rank and leftmost
first, in n log n; linked neighbours take no copies. Pieces met before are looked up, and so are, where a space
before another character always begins a piece, whole chunks between single spaces.

Guards, as the long-text wrapper has them: a text is taken in stretches of at most LONGEST characters, and a
stretch is cut where more than RUN characters in a row are all white space or all not.

Special tokens are ordinary text unless they are allowed. A text's end stands before it.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a stretch, and of a run of one kind: fixed values of the wrapper.
LONGEST, RUN = 400_000, 25_000
#: Patterns by model: fixed values, which ids depend on.
PATTERNS = {
    "gpt-2": r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    "llama-3": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}
#: Special tokens by model, in the order of their ids: fixed values. The second kind is filled up to 256 with reserved ones.
SPECIAL = {
    "gpt-2": ("<|endoftext|>",),
    "llama-3": ("<|begin_of_text|>", "<|end_of_text|>", "<|reserved_special_token_0|>", "<|reserved_special_token_1|>", "<|finetune_right_pad_id|>", "<|step_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|eom_id|>", "<|eot_id|>", "<|python_tag|>"),
}
#: What stands before each document.
END = {"gpt-2": "<|endoftext|>", "llama-3": "<|begin_of_text|>"}
#: Bytes of a token in a shard.
WIDTH = {"gpt-2": 2, "llama-3": 4}
#: Runs of white space and of other characters.
KINDS = re.compile(r"[\s\x1c-\x1f]+|[^\s\x1c-\x1f]+")
#: Pieces, and chunks, that a tokenizer remembers.
KEPT = 200_000
#: Rows that a task turns to Python at once.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A file with a base64 byte string and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def special_tokens(model: str, first: int) -> dict[str, int]:
    names = list(SPECIAL[model])
    if model == "llama-3":
        names += [f"<|reserved_special_token_{i}|>" for i in range(2, 2 + 256 - len(names))]
    return {n: first + i for i, n in enumerate(names)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece. Pairs wait in a heap by rank and place; one whose sides have changed since is passed over."""
    if piece in ranks:
        return [ranks[piece]]
    part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(part)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n:
            joint = part[i] + part[j]
            rank = ranks.get(joint)
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(joint)))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i, right[i])
        offer(left[i], i)
    return [ranks[p] for p in part if p is not None]


def stretches(text: str, longest: int = LONGEST, run: int = RUN) -> Iterator[str]:
    """Parts of a text, none longer than `longest` and none with more than `run` characters in a row of one kind."""
    for lo in range(0, len(text), longest):
        part, at = text[lo : lo + longest], 0
        if len(part) > run:
            for m in KINDS.finditer(part):
                for i in range(m.start() + run, m.end(), run):
                    yield part[at:i]
                    at = i
        yield part[at:]


@dataclass
class Tokenizer:
    ranks: dict[bytes, int]
    pattern: str
    special: dict[str, int] = field(default_factory=dict)
    longest: int = LONGEST
    run: int = RUN

    def __post_init__(self):
        import regex

        self.pieces = regex.compile(self.pattern).findall
        self.strings = {v: k for k, v in self.ranks.items()} | {v: k.encode() for k, v in self.special.items()}
        self.kept: dict[str, list[int]] = {}
        self.chunks: dict[str, bytes] = {}
        self.spaced = self.pattern in PATTERNS.values()

    @property
    def size(self) -> int:
        return len(self.ranks) + len(self.special)

    def ordinary(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text):
            ids = self.kept.get(p)
            if ids is None:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                ids = self.kept[p] = merged(p.encode(), self.ranks)
            out += ids
        return out

    def packed(self, text: str, first: str | None = None) -> bytes:
        """Ids of a text without special tokens but `first`, as `encode` gives them, in 32 bits each."""
        out = [] if first is None else [np.array([self.special[first]], "<i4").tobytes()]
        return b"".join([*out, *map(self._stretch, stretches(text, self.longest, self.run))])

    def _whole(self, text: str) -> bytes:
        return np.array(self.ordinary(text), "<i4").tobytes()

    def _stretch(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if not self.spaced or not rest or not head or head[-1].isspace():
            return self._whole(text)
        got = list(map(self.chunks.get, rest))
        if None in got:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            for i, x in enumerate(got):
                if x is None:
                    chunk = rest[i]
                    if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                        return self._whole(text)
                    got[i] = self._whole(" " + chunk)
                    if len(chunk) <= 64:
                        self.chunks[chunk] = got[i]
        return self._whole(head) + b"".join(got)

    def encode(self, text: str, first: str | None = None, last: str | None = None, allowed: Collection[str] = (), refused: Collection[str] = ()) -> list[int]:
        """Ids of a text; the special tokens first and last go around it. Of special tokens in the text, those
        allowed become their ids, those refused raise an error, others are ordinary text."""
        for name in refused:
            if name in self.special and name not in allowed and name in text:
                raise ValueError(f"special token {name} in a text")
        out = [] if first is None else [self.special[first]]
        names = sorted((n for n in allowed if n in self.special), key=len, reverse=True)
        cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        for part in stretches(text, self.longest, self.run):
            for i, x in enumerate(cut.split(part) if cut else [part]):
                out += [self.special[x]] if i % 2 else self.ordinary(x)
        return out if last is None else [*out, self.special[last]]

    def decode(self, ids: Collection[int]) -> bytes:
        return b"".join(self.strings[i] for i in ids)

    @functools.cached_property
    def table(self) -> pa.Array:
        """The strings by id, null for an id that there isn't."""
        return pa.array([self.strings.get(i) for i in range(max(self.strings, default=-1) + 1)], pa.large_binary())


@functools.lru_cache(maxsize=2)
def tokenizer(model: str, path: str) -> Tokenizer:
    """A model's tokenizer over a file of ranks; one for each Python worker."""
    ranks = read_ranks(path)
    return Tokenizer(ranks, PATTERNS[model], special_tokens(model, len(ranks)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time, so that a worker's memory doesn't grow with a batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def tokenised(docs: DataFrame, key: str, text: str, model: str, path: str, kind: str | None = None) -> DataFrame:
    """(key, ids): the end of a text, then its ids, for each row with a text; path: the ranks' file, which all
    executors can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokenizer(model, path), END[model]
        for batch in _slices(batches):
            got = [t.packed(x, end) for x in batch.column(1).to_pylist()]
            at = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    rows = docs.select(key, F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull())
    return rows.mapInArrow(run, f"{key} {kind or dict(docs.dtypes)[key]}, ids array<int>")


def detokenised(rows: DataFrame, key: str, ids: str, model: str, path: str) -> DataFrame:
    """(key, bytes) of (key, ids); an id that the tokenizer lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(model, path)
        for batch in _slices(batches):
            ids = batch.column(1)
            at = ids.offsets.to_numpy()
            strings = t.table.take(ids.flatten())  # an id beyond the table is an error
            if strings.null_count or ids.null_count:
                raise ValueError("an id that the tokenizer lacks")
            ends = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)[at - at[0]]
            held = strings.buffers()[2].slice(int(ends[0])) if len(strings) else pa.py_buffer(b"")
            texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends - ends[0]), held])
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.binary())], names=[key, "bytes"])

    return rows.select(key, ids).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, bytes binary")
