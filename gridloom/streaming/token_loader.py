"""A sharded token loader as a streaming source that goes on where it stopped.

Each rank goes through all shards in an order of its own, drawn by a generator seeded with seed + rank: the
order of shards is shuffled again each epoch, and the samples of a shard when it comes up. A sample is one
batch of every rank; a step takes one sample of each rank.

The stream's offset is the number of steps taken; it is written to the query's log and everything else follows
from it. A trigger takes `steps` steps; after `epochs` epochs of rank 0, or never, the stream has no more. Tasks
read the byte ranges of their samples and nothing else. A query that stops anywhere and starts again gives
the rows of an unbroken run.

A cursor's state (step, epoch, places, permutations, generator) is a row of numbers: `states` makes a table
of them, which goes into a checkpoint, and a stream may begin from one.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.token_shards import HEADER, KINDS

SCHEMA = "step long, epoch long, rank int, shard int, sample long, row int, inputs array<int>, targets array<int>"
STATE = "rank int, ranks int, shuffle boolean, step long, epoch long, place long, sample long, shards array<long>, samples array<long>, words array<long>, word int"
#: Samples that one task reads, samples of a batch of rows at most, and tokens of one, about.
READS, TOGETHER, TOKENS = 1024, 64, 1 << 20


class Generator:
    """MT19937 as the loaders seed it, with a modulo-biased shuffle from the end."""

    def __init__(self, seed: int):
        self.bits = np.random.RandomState(seed & 0xFFFFFFFF)._bit_generator

    def shuffled(self, p: list[int]) -> list[int]:
        p = list(p)
        for i, r in zip(range(len(p) - 1, 0, -1), self.bits.random_raw(max(0, len(p) - 1)).tolist()):
            j = r % (i + 1)
            p[i], p[j] = p[j], p[i]
        return p

    def state(self) -> tuple[list[int], int]:
        s = self.bits.state["state"]
        return s["key"].tolist(), int(s["pos"])

    def restore(self, words: list[int], word: int) -> None:
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(words, np.uint32), "pos": word}}


class Cursor:
    """A rank's place. sizes: samples of each shard, each at least one."""

    def __init__(self, sizes: list[int], rank: int = 0, ranks: int = 1, shuffle: bool = True, seed: int = 42):
        if not sizes or min(sizes) < 1:
            raise ValueError("every shard needs a batch of all ranks and a target for its last token")
        self.sizes, self.rank, self.ranks, self.shuffle = sizes, rank, ranks, shuffle
        self.step = self.epoch = 0
        self.generator = Generator(seed + rank)
        self.shards = list(range(len(sizes)))
        self.reset()

    def reset(self) -> None:
        self.place = 0
        if self.shuffle:
            self.shards = self.generator.shuffled(self.shards)
        self.begin()

    def begin(self) -> None:
        self.sample = 0
        n = range(self.sizes[self.shards[self.place]])
        self.samples = self.generator.shuffled(list(n)) if self.shuffle else n

    def take(self) -> tuple[int, int, int, int]:
        """(step, epoch, shard, sample) of the next batch; the place moves on when a batch is asked for, not before."""
        if self.sample >= len(self.samples):
            if self.place == len(self.shards) - 1:
                self.epoch += 1
                self.reset()
            else:
                self.place += 1
                self.begin()
        out = (self.step, self.epoch, self.shards[self.place], self.samples[self.sample])
        self.sample += 1
        self.step += 1
        return out

    def state(self) -> tuple:
        words, word = self.generator.state()
        return (self.rank, self.ranks, self.shuffle, self.step, self.epoch, self.place, self.sample, list(self.shards), list(self.samples), words, word)

    @classmethod
    def restored(cls, sizes: list[int], state: tuple) -> Cursor:
        rank, ranks, shuffle, step, epoch, place, sample, shards, samples, words, word = state
        c = cls(sizes, rank, ranks, shuffle)
        if sorted(shards) != list(range(len(sizes))) or len(samples) != sizes[shards[place]]:
            raise ValueError("the state is of other shards")
        c.step, c.epoch, c.place, c.sample, c.shards, c.samples = step, epoch, place, sample, list(shards), list(samples)
        c.generator.restore(words, word)
        return c


def _shards(uri: str, per: int) -> tuple[list[str], list[int], list[int]]:
    """Paths, token widths and samples of `per` tokens of all shards; headers are checked."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(uri)
    files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".bin"))
    if not files:
        raise ValueError(f"no shards in {uri}")
    widths, samples = [], []
    for path, size in files:
        with fs.open_input_file(path) as f:
            head = np.frombuffer(f.read(12), "<i4")
        width = next((w for w, kind in KINDS.items() if len(head) == 3 and tuple(head[:2]) == kind), None)
        if width is None or size != 4 * HEADER + width * int(head[2]):
            raise ValueError(f"{path}: not a whole token shard of a known version")
        widths.append(width)
        samples.append((int(head[2]) - 1) // per)
    return [p for p, _ in files], widths, samples


@dataclass
class _Reads(InputPartition):
    rank: int
    #: (step, epoch, shard, sample, path, token width, byte offset)
    items: list[tuple]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.b, self.t = int(options.get("b", 4)), int(options.get("t", 64))
        self.ranks, self.steps = int(options.get("ranks", 1)), int(options.get("steps", 16))
        self.seed, self.shuffle = int(options.get("seed", 42)), str(options.get("shuffle", "true")).lower() == "true"
        self.epochs = int(options["epochs"]) if "epochs" in options else None
        self.begin = [tuple(s) for s in json.loads(options["state"])] if "state" in options else None
        self.paths, self.widths, self.sizes = _shards(self.uri, self.b * self.t * self.ranks)
        self.planned: int | None = None
        self.rewind()

    def rewind(self) -> None:
        if self.begin:
            self.cursors = [Cursor.restored(self.sizes, s) for s in self.begin]
        else:
            self.cursors = [Cursor(self.sizes, r, self.ranks, self.shuffle, self.seed) for r in range(self.ranks)]
        self.first = self.cursors[0].step

    def initialOffset(self) -> dict:
        return {"step": self.first}

    def latestOffset(self) -> dict:
        at = self.first if self.planned is None else self.planned
        end = at + self.steps
        if self.epochs is not None:
            end = max(at, min(end, self.epochs * sum(self.sizes)))
        self.planned = end
        return {"step": end}

    def partitions(self, start: dict, end: dict) -> list[_Reads]:
        lo, hi = start["step"], end["step"]
        self.planned = hi if self.planned is None else max(self.planned, hi)  # a query that starts again plans its last batch first
        if self.cursors[0].step > lo:
            self.rewind()
        out, size = [], self.b * self.t
        for c in self.cursors:
            while c.step < lo:
                c.take()
            items = []
            for _ in range(lo, hi):
                step, epoch, shard, sample = c.take()
                items.append((step, epoch, shard, sample, self.paths[shard], self.widths[shard], 4 * HEADER + self.widths[shard] * (sample * size * self.ranks + c.rank * size)))
            out += [_Reads(c.rank, items[i : i + READS]) for i in range(0, len(items), READS)]
        return out

    def read(self, partition: _Reads) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.uri)
        b, t = self.b, self.t
        each = max(1, min(TOGETHER, TOKENS // (b * t)))
        for lo in range(0, len(partition.items), each):
            part, tokens = partition.items[lo : lo + each], []
            for path, same in itertools.groupby(part, lambda x: x[4]):
                with fs.open_input_file(path) as f:
                    for *_, width, offset in same:
                        f.seek(offset)
                        tokens.append(np.frombuffer(f.read(width * (b * t + 1)), f"<u{width}").astype(np.int32))
            n = len(part)
            of = lambda i, kind: pa.array(np.repeat([x[i] for x in part], b), kind)
            at = pa.array(np.arange(n * b + 1) * t, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [of(0, pa.int64()), of(1, pa.int64()), pa.array(np.full(n * b, partition.rank), pa.int32()), of(2, pa.int32()), of(3, pa.int64()), pa.array(np.tile(np.arange(b), n), pa.int32()), pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[:-1] for x in tokens]))), pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[1:] for x in tokens])))],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    def commit(self, end: dict) -> None:
        pass


class TokenLoader(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_loader"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream(spark: SparkSession, uri: str, b: int, t: int, ranks: int = 1, steps: int = 16, shuffle: bool = True, seed: int = 42, epochs: int | None = None, state: list[tuple] | None = None) -> DataFrame:
    """Rows of all ranks' batches, `steps` steps a trigger, from the beginning or from saved states of all ranks."""
    spark.dataSource.register(TokenLoader)
    r = spark.readStream.format("token_loader").options(path=uri, b=b, t=t, ranks=ranks, steps=steps, shuffle=str(shuffle).lower(), seed=seed)
    if epochs is not None:
        r = r.option("epochs", epochs)
    if state is not None:
        r = r.option("state", json.dumps(sorted(state)))
    return r.load()


def states(spark: SparkSession, uri: str, b: int, t: int, step: int, ranks: int = 1, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """The state of each rank's cursor after `step` steps, a row a rank; see STATE."""
    _, _, sizes = _shards(uri, b * t * ranks)
    rows = []
    for rank in range(ranks):
        c = Cursor(sizes, rank, ranks, shuffle, seed)
        for _ in range(step):
            c.take()
        rows.append(c.state())
    return spark.createDataFrame(rows, STATE)
