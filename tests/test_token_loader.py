"""The streaming loader: order, byte ranges, restarts at any batch, and saved states."""

import numpy as np
import pytest

from gridloom.operators.tokens import MersenneTwister
from gridloom.sources import token_shards
from gridloom.streaming import token_loader as tl

SIZES = [70, 43, 129, 64]
B, T, RANKS = 2, 4, 2


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    base = tmp_path_factory.mktemp("shards")
    for i, n in enumerate(SIZES):
        (base / f"s{i}.bin").write_bytes(token_shards.encode(np.arange(n) + 1000 * i, 4 if i == 2 else 2))
    return f"file://{base}"


def expected(steps, shuffle, seed=42):
    """(step, epoch, rank, shard, sample) by the plain order of draws."""
    each = [(n - 1) // (B * T * RANKS) for n in SIZES]
    rows = []
    for rank in range(RANKS):
        g, order, taken, epoch = MersenneTwister(seed + rank), list(range(len(SIZES))), 0, 0
        while taken < steps:
            order = g.shuffled(order) if shuffle else order
            for s in order:
                inner = g.permutation(each[s]) if shuffle else list(range(each[s]))
                for k in inner:
                    if taken < steps:
                        rows.append((taken, epoch, rank, s, k))
                        taken += 1
            epoch += 1
    return sorted(rows)


def run(spark, df, tmp, name, batches=None):
    """Runs a stream into Parquet until nothing comes, or stops it after some batches."""
    q = df.writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-log").start()
    try:
        while batches is None or (q.lastProgress or {"batchId": -1})["batchId"] + 1 < batches:
            if batches is None:
                q.processAllAvailable()
                break
            assert q.isActive, q.exception()
    finally:
        q.stop()
    return spark.read.parquet(f"{tmp}/{name}") if (tmp / name).exists() else None


def rows(df):
    return sorted((r.step, r["rank"], r.row, r.epoch, r.shard, r["sample"], tuple(r.inputs), tuple(r.targets)) for r in df.collect())


@pytest.mark.parametrize("shuffle", [True, False])
def test_cursors_follow_the_draws(shuffle):
    each = [(n - 1) // (B * T * RANKS) for n in SIZES]
    got = []
    for rank in range(RANKS):
        c = tl.Cursor(each, rank, RANKS, shuffle)
        for step in range(50):
            got.append((*c.take()[:2], rank, *[c.shards[c.place], c.samples[c.sample - 1]]))
            if step % 7 == 3:  # saved and restored anywhere
                c = tl.Cursor.restored(each, c.state())
    assert sorted(got) == expected(50, shuffle)


def test_stream_stopped_anywhere_gives_the_unbroken_rows(spark, shards, tmp_path):
    make = lambda: tl.stream(spark, shards, B, T, RANKS, steps=5, epochs=2)
    each = sum((n - 1) // (B * T * RANKS) for n in SIZES)
    whole = rows(run(spark, make(), tmp_path, "whole"))
    assert sorted({(r[0], r[3], r[1], r[4], r[5]) for r in whole}) == expected(2 * each, True)
    for step, rank, row, _, shard, sample, x, y in whole:
        at = 1000 * shard + sample * B * T * RANKS + rank * B * T + row * T
        assert x == tuple(range(at, at + T)) and y == tuple(range(at + 1, at + T + 1))
    for stop in (1, 3):
        run(spark, make(), tmp_path, f"cut{stop}", stop)
        run(spark, make(), tmp_path, f"cut{stop}", stop + 1)
        assert rows(run(spark, make(), tmp_path, f"cut{stop}")) == whole


def test_stream_begins_from_saved_states(spark, shards, tmp_path):
    whole = rows(run(spark, tl.stream(spark, shards, B, T, RANKS, steps=50, epochs=2), tmp_path, "all"))
    tl.states(spark, shards, B, T, 7, RANKS).write.parquet(f"{tmp_path}/state")
    saved = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/state").select(*[f.split()[0] for f in tl.STATE.split(", ")]).collect()]
    assert len(saved) == RANKS and all(len(s[9]) == 624 for s in saved)
    rest = rows(run(spark, tl.stream(spark, shards, B, T, RANKS, steps=50, epochs=2, state=saved), tmp_path, "rest"))
    assert rest == [r for r in whole if r[0] >= 7]


def test_short_shards_and_other_states_are_refused(shards, tmp_path):
    with pytest.raises(ValueError):
        tl.Cursor([3, 0])
    with pytest.raises(ValueError):
        tl.Cursor.restored([3, 4], tl.Cursor([3, 4, 5]).state())
    (tmp_path / "s.bin").write_bytes(token_shards.encode(np.arange(9))[:-1])
    with pytest.raises(ValueError):
        tl._shards(f"file://{tmp_path}", 4)


def test_samples_are_read_together(tmp_path):
    for i in range(2):
        (tmp_path / f"s{i}.bin").write_bytes(token_shards.encode(np.arange(33) + 100 * i))
    r = tl._Reader({"path": f"file://{tmp_path}", "b": 2, "t": 4, "shuffle": "false"})
    (part,) = r.partitions({"step": 0}, {"step": 8})
    (batch,) = r.read(part)
    assert batch.num_rows == 16 and batch.column("step").to_pylist() == [s for s in range(8) for _ in range(2)]
    assert [x for y in batch.column("inputs").to_pylist() for x in y] == [*range(32), *range(100, 132)]
    assert [x for y in batch.column("targets").to_pylist() for x in y] == [*range(1, 33), *range(101, 133)]
