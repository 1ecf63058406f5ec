"""Token shards as a Python data source: a 256-int32 header, then tokens of 2 or 4 bytes.

An input partition is shards of about READ bytes, in order; a header of another magic, version or size is refused. The writer
makes a shard of each task's rows in the order they come, under names that carry the task's number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 256
#: (magic, version) by token width in bytes: fixed values of the format.
KINDS = {2: (20240520, 1), 4: (20240801, 7)}
#: Bytes of shards that one task reads, about.
READ = 16 << 20
SCHEMA = "shard int, pos bigint, tok bigint"


def encode(tokens: np.ndarray, width: int = 2) -> bytes:
    head = np.zeros(HEADER, "<i4")
    head[:3] = (*KINDS[width], len(tokens))
    return head.tobytes() + np.asarray(tokens).astype(f"<u{width}").tobytes()


def decode(data: bytes, name: str = "shard") -> np.ndarray:
    head = np.frombuffer(data[: 4 * HEADER], "<i4")
    width = next((w for w, kind in KINDS.items() if len(head) == HEADER and tuple(head[:2]) == kind), None)
    if width is None:
        raise ValueError(f"{name}: not a token shard of a known version")
    if len(data) != 4 * HEADER + width * int(head[2]):
        raise ValueError(f"{name}: {head[2]} tokens announced, {len(data) - 4 * HEADER} bytes found")
    return np.frombuffer(data[4 * HEADER :], f"<u{width}")


class _Shards(InputPartition):
    def __init__(self, first: int, paths: list[str]):
        self.first, self.paths = first, paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Shards]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(self.path)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".bin"))
        if not files:
            raise ValueError(f"no shards in {self.path}")
        out, room = [], 0
        for i, (path, size) in enumerate(files):
            if size > room:
                out.append(_Shards(i, []))
                room = READ
            out[-1].paths.append(path)
            room -= size
        return out

    def read(self, partition: _Shards) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.path)
        for number, path in enumerate(partition.paths, partition.first):
            with fs.open_input_stream(path) as f:
                tokens = decode(f.read(), path)
            for lo in range(0, len(tokens), 1 << 16):
                t = tokens[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), number, np.int32)), pa.array(np.arange(lo, lo + len(t))), pa.array(t.astype(np.int64))], names=["shard", "pos", "tok"])


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").option("path", uri).load()


def write_pieces(pieces: DataFrame, uri: str, width: int = 2) -> list[tuple[int, int]]:
    """A shard file for each value of `shard` from pieces (shard, start, ids) that follow each other; returns (shard, tokens)."""

    def one(key, t):
        t = t.sort_by("start")
        tok = t["ids"].combine_chunks().flatten().to_numpy()
        return _file(uri, key[0].as_py(), tok, width)

    # a shard has a fixed size, so a group is bounded
    return [tuple(r) for r in pieces.select("shard", "start", "ids").groupBy("shard").applyInArrow(one, "shard long, n long").collect()]


def _file(uri: str, shard: int, tok: np.ndarray, width: int) -> pa.Table:
    """Writes one shard; a file that isn't whole never has its name."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    part = f"{base}/shard_{shard:06d}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(encode(tok, width))
    fs.move(part, f"{base}/shard_{shard:06d}.bin")
    return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(tok)], pa.int64())})


def write(tokens: DataFrame, uri: str, width: int = 2) -> list[tuple[int, int]]:
    """A shard file for each value of `shard`, tokens by pos; returns (shard, tokens)."""

    def one(key, t):
        return _file(uri, key[0].as_py(), t.sort_by("pos")["tok"].to_numpy(), width)

    # a shard has a fixed size, so a group is bounded
    return [tuple(r) for r in tokens.select("shard", "pos", "tok").groupBy("shard").applyInArrow(one, "shard long, n long").collect()]
