"""Files by executors, tile products, seeded draws, diagonals, figures of runs."""

import random

import numpy as np
import pytest

from gridloom.operators import cholesky, optim, sampling, telemetry, vectors
from gridloom.operators.ordering import accumulated
from gridloom.sources import binary_files as b

EXAMPLES = "key long, label long, context array<long>, endings array<array<long>>"


def test_examples_go_to_several_files_and_keep_their_numbers(spark, tmp_path):
    rows = [(k, k % 4, [k] * (k % 3), [[c] * (k % 5) for c in range(4)]) for k in range(25)] + [(None, None, None, [[1], None, [2], []])]
    uri = f"file://{tmp_path}/examples"
    b.write_examples(accumulated(spark.createDataFrame(rows, EXAMPLES), ["key"]), uri, per=10)
    files = sorted((tmp_path / "examples").iterdir())
    assert [f.name for f in files] == [f"rows-{k:020d}.bin" for k in (0, 10, 20)]
    assert [len(b.decode_examples(f.read_bytes())) for f in files] == [10, 10, 6]
    got = {r.i: (r.label, r.context, r.endings) for r in b.read_examples(spark, uri).collect()}
    assert got == {0: (0, [], [[1], [], [2], []])} | {k + 1: (label, context, endings) for k, label, context, endings in rows[:-1]}


def test_examples_of_no_rows_and_beyond_the_format(spark, tmp_path):
    b.write_examples(accumulated(spark.createDataFrame([], EXAMPLES), ["key"]), f"file://{tmp_path}/none")
    assert b.read_examples(spark, f"file://{tmp_path}/none").count() == 0
    long = spark.createDataFrame([(1, 0, [5] * 40_000, [[1]] * 4)], EXAMPLES)
    with pytest.raises(Exception, match="doesn't fit the format"):
        b.write_examples(accumulated(long, ["key"]), f"file://{tmp_path}/long")


def test_tokenizer_tables_of_several_files(spark, tmp_path):
    pieces = sorted(random.Random(3).randbytes(n) for n in range(1, 256))
    rows = spark.createDataFrame([(bytearray(p),) for p in pieces], "piece binary")
    b.write_tokenizer(accumulated(rows, ["piece"]), f"file://{tmp_path}/pieces", per=100)
    got = sorted((r.id, bytes(r.piece), r.printable) for r in b.read_tokenizer(spark, f"file://{tmp_path}/pieces").collect())
    assert got == [(i, p, b.printable(p)) for i, p in enumerate(pieces)]


@pytest.mark.parametrize("columns, size", [(12, 7), (10, 64), (3, 1)])
def test_tile_products(spark, columns, size):
    x = np.random.default_rng(1).normal(size=(40, columns))
    rows = [(i // 2 if i % 5 else None, v.tolist()) for i, v in enumerate(x)] + [(1, None)]
    g = cholesky.from_tiles(cholesky.gram(cholesky.panels(spark.createDataFrame(rows, "key long, x array<double>"), "key", "x", 4, size), 4), 4)
    got = {(r.i, r.j): r.v for r in g.where("i >= j").collect()}
    wide = -(-columns // 4) * 4
    want = np.zeros((wide, wide))
    want[:columns, :columns] = x.T @ x
    assert len(got) == wide * (wide + 1) // 2 and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_tile_products_of_no_rows(spark):
    none = spark.createDataFrame([], "key long, x array<double>")
    assert cholesky.gram(cholesky.panels(none, "key", "x", 4), 4).count() == 0


def test_draws_are_those_of_the_generator(spark):
    seeds = [1, 2, 1337, 2**31, 2**62 + 12345, -1, -(2**63), 2**63 - 1] + [random.Random(k).randrange(-(2**63), 2**63) for k in range(50)]
    rows = spark.createDataFrame([(s,) for s in [*seeds, 0, None]], "s long")
    for r in rows.select("s", sampling.drawn(rows.s, 5).alias("d")).collect():
        if r.s is None:
            assert all(x.u32 is None for x in r.d)
            continue
        g, h = sampling.XorShift(r.s), sampling.XorShift(r.s)
        assert [(x.u32, x.f32) for x in r.d] == [(g.u32(), h.f32()) for _ in range(5)]


def test_zero_diagonals(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.0), (1, 2, 5.0), (3, 3, -2.0), (3, 0, 0.0)], "i long, j long, v double")
    assert vectors.zero_diagonals(a, spark.range(4).toDF("i")).head() == (4, 5, 2, 1.25)
    assert vectors.zero_diagonals(a.where("false"), spark.range(0).toDF("i")).head() == (0, 0, 0, None)


def test_figures_of_merit(spark):
    runs = spark.createDataFrame([(2.0, 100, 10, 8), (2.0, 0, 10, 8), (None, 1, 1, 1), (0.0, 1, 1, 1)], "seconds double, cycles long, side long, ranks long")
    got = [(r.grind, r.overall, r.fom) for r in telemetry.figures_of_merit(runs).collect()]
    assert got[0] == (20.0, 2.5, 400.0) and got[1] == got[2] == (None,) * 3 and got[3] == (0.0, 0.0, None)


def test_shards_of_optimiser_state(spark):
    assert (optim.shard_size(64, 4), optim.shard_size(65, 4), optim.shard_size(64, 4, 0)) == (16, 65, 64)
    for stage in (2, 3):
        with pytest.raises(ValueError):
            optim.shard_size(64, 4, stage)
    g = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 5.0), (0, 3, 4.0), (1, 3, None)], "rank long, i long, g double")
    assert sorted(map(tuple, optim.reduce_scatter(g, 2).collect())) == [(0, 0, 0, 4.0), (1, 2, 3, 4.0)]
