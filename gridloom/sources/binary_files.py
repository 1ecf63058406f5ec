"""Evaluation files, tokenizer tables and model checkpoints.

All begin with 256 32-bit integers: a magic number, a version and counts, which are checked against
what follows. Magic numbers, versions and the tensors' order are fixed values of the formats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

HEAD = 1024
EVAL, TOKENIZER, MODEL = 20240522, 20240328, 20240326
#: Value width and kind of a checkpoint's versions.
WIDTH = {3: "<f4", 5: "bf16"}
TENSORS = "wte wpe ln1w ln1b qkvw qkvb attprojw attprojb ln2w ln2b fcw fcb fcprojw fcprojb lnfw lnfb".split()


def _head(data: bytes, magic: int, what: str) -> np.ndarray:
    head = np.frombuffer(data[:HEAD], "<i4")
    if len(head) < 256 or head[0] != magic:
        raise ValueError(f"not a {what}")
    return head


@dataclass(frozen=True)
class Example:
    label: int
    context: list[int]
    endings: list[list[int]]


def encode_examples(examples: list[Example]) -> bytes:
    """Multiple-choice examples: each a delimiter, its bytes, number, label, count of endings, and
    length-prefixed runs of 16-bit tokens, context first."""
    parts, longest = [], 0
    for i, x in enumerate(examples):
        runs = [x.context, *x.endings]
        body = [t for r in runs for t in (len(r), *r)]
        # the count of endings stands before the context's run
        words = np.array([65535, 0, i, x.label, len(x.endings), *body], np.int64)
        size = 2 * len(words)
        if size >= 1 << 16 or len(examples) >= 1 << 16 or (words[2:] >= 65535).any() or (words < 0).any():
            raise ValueError(f"example {i} doesn't fit the format")
        words[1], longest = size, max(longest, size)
        parts.append(words.astype("<u2").tobytes())
    head = np.zeros(256, "<i4")
    head[:4] = (EVAL, 1, len(examples), longest)
    return head.tobytes() + b"".join(parts)


def decode_examples(data: bytes) -> list[Example]:
    head = _head(data, EVAL, "evaluation file")
    w, at, out = np.frombuffer(data[HEAD:], "<u2"), 0, []
    for i in range(int(head[2])):
        if at + 5 > len(w) or w[at] != 65535 or w[at + 2] != i:
            raise ValueError(f"example {i} doesn't begin where it should")
        end, runs, p = at + int(w[at + 1]) // 2, [], at + 5
        for _ in range(int(w[at + 4]) + 1):
            runs.append(w[p + 1 : p + 1 + int(w[p])].tolist())
            p += 1 + int(w[p])
        if p != end or end > len(w):
            raise ValueError(f"example {i} isn't as long as it says")
        out.append(Example(int(w[at + 3]), runs[0], runs[1:]))
        at = end
    return out


def encode_tokenizer(pieces: list[bytes], end: int) -> bytes:
    head = np.zeros(256, "<i4")
    head[:4] = (TOKENIZER, 2, len(pieces), end)
    if not all(0 < len(p) < 256 for p in pieces):
        raise ValueError("a piece has 1 to 255 bytes")
    return head.tobytes() + b"".join(bytes([len(p)]) + p for p in pieces)


def decode_tokenizer(data: bytes) -> tuple[list[bytes], int]:
    """(pieces by id, id of the end of a text)."""
    head = _head(data, TOKENIZER, "tokenizer table")
    if head[1] not in (1, 2) or head[1] == 1 and head[2] != 50257:
        raise ValueError(f"tokenizer table of version {head[1]}")
    out, at = [], HEAD
    for i in range(int(head[2])):
        n = data[at] if at < len(data) else 0
        if not n or at + 1 + n > len(data):
            raise ValueError(f"piece {i} is empty or cut short")
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return out, 50256 if head[1] == 1 else int(head[3])


def printable(piece: bytes) -> bool:
    """Whether a piece is shown: single bytes must be printable or white space."""
    return bool(piece) and (len(piece) > 1 or 32 <= piece[0] < 127 or 9 <= piece[0] <= 13)


def tensor_sizes(context: int, vocabulary: int, layers: int, channels: int) -> dict[str, int]:
    """Values of each tensor, in file order; vocabulary is the padded one."""
    c, per = channels, layers * channels
    return dict(zip(TENSORS, (vocabulary * c, context * c, per, per, 3 * per * c, 3 * per, per * c, per, per, per, 4 * per * c, 4 * per, 4 * per * c, per, c, c)))


def to_bf16(x: np.ndarray) -> np.ndarray:
    """Rounded to the nearest, ties to even, as 16-bit patterns."""
    b = x.astype("<f4").view("<u4").astype(np.uint64)
    return ((b + 0x7FFF + ((b >> np.uint64(16)) & np.uint64(1))) >> np.uint64(16)).astype("<u2")


def from_bf16(x: np.ndarray) -> np.ndarray:
    return (x.astype("<u4") << 16).view("<f4")


def encode_checkpoint(values: np.ndarray, context: int, vocab: int, layers: int, heads: int, channels: int, padded: int, version: int = 3) -> bytes:
    """A checkpoint of all tensors' values end to end."""
    if len(values) != sum(tensor_sizes(context, padded, layers, channels).values()):
        raise ValueError("another number of values than the sizes ask for")
    head = np.zeros(256, "<i4")
    head[:8] = (MODEL, version, context, vocab, layers, heads, channels, padded)
    return head.tobytes() + (values.astype("<f4") if version == 3 else to_bf16(values)).tobytes()


def read_checkpoint(spark: SparkSession, uri: str, chunk: int = 1 << 20) -> DataFrame:
    """(tensor, idx, val): each task reads its own byte ranges; no file is read whole."""
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        head, size = _head(f.read(HEAD), MODEL, "model checkpoint"), f.size()
    kind = WIDTH.get(int(head[1]))
    if kind is None:
        raise ValueError(f"model checkpoint of version {head[1]}")
    width = 4 if kind == "<f4" else 2
    ranges, at = [], 0
    for name, n in tensor_sizes(int(head[2]), int(head[7]), int(head[4]), int(head[6])).items():
        ranges += [(name, lo, min(chunk, n - lo), HEAD + width * (at + lo)) for lo in range(0, n, chunk)]
        at += n
    if size != HEAD + width * at:
        raise ValueError(f"{size} bytes, not {HEAD + width * at}")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, own = pafs.FileSystem.from_uri(uri)
        with files.open_input_file(own) as f:
            for batch in batches:
                for name, lo, n, offset in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    f.seek(offset)
                    raw = f.read(width * n)
                    v = np.frombuffer(raw, "<f4") if width == 4 else from_bf16(np.frombuffer(raw, "<u2"))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(lo, lo + n)), pa.array(v.astype(np.float64))], names=["tensor", "idx", "val"])

    parts = spark.createDataFrame(ranges, "tensor string, lo long, n long, offset long").repartition(min(len(ranges), 4096))
    return parts.mapInArrow(load, "tensor string, idx long, val double")


def put(uri: str, data: bytes) -> None:
    """data as a file at uri; a file that isn't whole never has the name."""
    import uuid

    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _first() -> Column:
    """The number of a file's first row, as files of `write_numbered` have it in their names; 0 for other names."""
    return F.coalesce(F.regexp_extract("path", r"/rows-(\d{20})\.bin$", 1).try_cast("long"), F.lit(0)).alias("first")


def _decoded(spark: SparkSession, uri: str, schema: str, decode) -> DataFrame:
    """Rows that decode makes of each file's bytes, whose numbers go on from the file's first one; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict(decode(data, first))

    return spark.read.format("binaryFile").load(uri).select(_first(), "content").mapInArrow(run, schema)


def write_numbered(rows: DataFrame, uri: str, per: int, encode: Callable[[pa.Table], bytes]) -> None:
    """Rows numbered by _k as files of `per` rows below uri, each written by a task of its own. A file's name tells its
    first number, so that a task that runs again writes the same one. No rows make one file of none."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_k")
        first = part["_k"][0].as_py()
        put(f"{uri}/rows-{first:020d}.bin", encode(part))
        return pa.table({"first": pa.array([first], pa.int64())})

    d = rows.withColumn("_f", F.floor(F.col("_k") / per))
    if not d.groupBy("_f").applyInArrow(run, "first long").agg(F.count(F.lit(1)).alias("n")).head().n:
        put(f"{uri}/rows-{0:020d}.bin", encode(to_arrow_schema(d.schema).empty_table()))


def write_examples(examples: DataFrame, uri: str, per: int = 4096) -> None:
    """(_k, label, context, endings) as evaluation files of `per` examples; the format holds 65,535 in a file. A null label is 0,
    null contexts and endings are empty; an example beyond what the format holds is refused."""

    def encode(part: pa.Table) -> bytes:
        columns = (part[c].to_pylist() for c in ("label", "context", "endings"))
        return encode_examples([Example(label or 0, context or [], [e or [] for e in endings or []]) for label, context, endings in zip(*columns)])

    write_numbered(examples, uri, min(per, 65535), encode)


def write_tokenizer(pieces: DataFrame, uri: str, per: int = 32768) -> None:
    """(_k, piece) as tokenizer tables of `per` pieces; the end of a text has the number after each table's last."""
    write_numbered(pieces, uri, per, lambda part: encode_tokenizer(part["piece"].to_pylist(), part.num_rows))


def read_tokenizer(spark: SparkSession, uri: str) -> DataFrame:
    """(id, piece, printable) of tokenizer tables."""

    def rows(data: bytes, first: int) -> dict:
        pieces, _ = decode_tokenizer(data)
        return {"id": pa.array(range(first, first + len(pieces)), pa.int64()), "piece": pa.array(pieces, pa.binary()), "printable": pa.array([printable(p) for p in pieces])}

    return _decoded(spark, uri, "id long, piece binary, printable boolean", rows)


def read_examples(spark: SparkSession, uri: str) -> DataFrame:
    """(i, label, context, endings) of evaluation files."""

    def rows(data: bytes, first: int) -> dict:
        e = decode_examples(data)
        return {"i": pa.array(range(first, first + len(e)), pa.int64()), "label": pa.array([x.label for x in e], pa.int64()), "context": pa.array([x.context for x in e], pa.list_(pa.int64())), "endings": pa.array([x.endings for x in e], pa.list_(pa.list_(pa.int64())))}

    return _decoded(spark, uri, "i long, label long, context array<long>, endings array<array<long>>", rows)
