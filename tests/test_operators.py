import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cholesky, generators, optim, sampling, solvers, telemetry, tokens, vectors
from gridloom.session import stored
from gridloom.sources import matrix_market, token_shards


@pytest.mark.parametrize("name", ["cg", "cr", "bicgstab"])
def test_solver_finds_ones(spark, name):
    a = stored(generators.stencil(spark, 3, 3, 3), "matrix")
    out = solvers.SOLVERS[name](a, generators.row_sums(a), iterations=8)
    assert max(abs(r.x - 1) for r in out.x.collect()) < 1e-6


def test_cg_stops_where_nothing_is_left(spark):
    a = spark.range(3).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
    out = solvers.cg(a, generators.row_sums(a), iterations=9)
    assert out.iterations == 1 and all(r.x == 1 for r in out.x.collect())


def test_back_substitution_skips_zero_pivots():
    h = np.array([[2.0, 1.0], [0.0, 0.0]])
    assert solvers.back_substitute(h, np.array([4.0, 1.0])).tolist() == [2.0, 0.0]


def test_tiled_cholesky_is_the_sequential_one(spark):
    a = generators.hashed_spd(spark, 8)
    dense = np.zeros((8, 8))
    for r in a.collect():
        dense[r.i, r.j] = r.v
    low = np.zeros((8, 8))
    for r in cholesky.from_tiles(cholesky.factor(cholesky.to_tiles(a, 4), 2, 4), 4).where("i >= j").collect():
        low[r.i, r.j] = r.v
    assert np.abs(low - cholesky.sequential(dense)).max() < 1e-9


def test_stencil_counts(spark):
    assert generators.stencil(spark, 4, 4, 4).count() == 10**3
    assert generators.stencil(spark, 4, 4, 4, 7).count() == 7 * 64 - 6 * 16


def test_detector_is_silent_first_and_sees_a_spike(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, float(v)) for i, v in enumerate(rng.uniform(-1, 1, 256))] + [(0, 256, 10.0)]
    z = [r.z for r in telemetry.sliding_zscore(spark.createDataFrame(rows, "s int, k int, v double"), "v", ["k"], ["s"]).orderBy("k").collect()]
    assert all(x is None for x in z[:128]) and all(abs(x) <= 3 for x in z[128:256]) and z[256] >= 5


@pytest.mark.parametrize("symmetry, sign", [("general", 0), ("symmetric", 1), ("skew-symmetric", -1)])
def test_matrix_market(spark, tmp_path, symmetry, sign):
    p = tmp_path / "a.mtx"
    p.write_text(f"%%MatrixMarket matrix coordinate real {symmetry}\n% note\n\n3 3 2\n2 1 4.5\n\n3 2 -1\n")
    got = {(r.i, r.j, r.v) for r in matrix_market.read(spark, str(p)).collect()}
    want = {(1, 0, 4.5), (2, 1, -1.0)}
    assert got == want | ({(j, i, sign * v) for i, j, v in want} if sign else set())


@pytest.mark.parametrize("text", ["%%MatrixMarket matrix array real general\n1 1\n1\n", "%%MatrixMarket matrix coordinate real general\n2 3 0\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n"])
def test_matrix_market_refuses(spark, tmp_path, text):
    p = tmp_path / "a.mtx"
    p.write_text(text)
    with pytest.raises(ValueError):
        matrix_market.read(spark, str(p))


def test_token_shard_codec():
    t = np.arange(140)
    for width in (2, 4):
        assert token_shards.decode(token_shards.encode(t, width)).tolist() == t.tolist()
    with pytest.raises(ValueError):
        token_shards.decode(token_shards.encode(t)[:-2])
    with pytest.raises(ValueError):
        token_shards.decode(b"\0" * 2000)


def test_loader_covers_every_token_once(spark):
    t = spark.range(4 * 141).select(F.floor(F.col("id") / 141).alias("shard"), (F.col("id") % 141).alias("pos"), F.col("id").alias("tok"))
    n = t.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(r.input for rank in (0, 1) for r in tokens.batches(t, n, 2, 8, 2, rank).collect())
    assert got == [s * 141 + p for s in range(4) for p in range(128)]
    assert all(r.target == r.input + 1 for r in tokens.batches(t, n, 2, 8, 2, 1).collect())


def test_random_numbers():
    mt = tokens.MersenneTwister(5489)
    assert [mt.u32() for _ in range(3)] == [3499211612, 581869302, 3890346734]
    assert sorted(tokens.MersenneTwister(42).permutation(50)) == list(range(50))
    x = sampling.XorShift(1337)
    assert all(0 <= x.f32() < 1 for _ in range(100))


def test_row_pointers_of_gaps(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (3, 0)], "i long, j long")
    got = vectors.row_pointers(a, spark.range(5).withColumnRenamed("id", "i"), blocks=2).orderBy("i").collect()
    assert [(r.start, r["count"]) for r in got] == [(0, 2), (2, 0), (2, 0), (2, 1), (3, 0)]


def test_schedules_meet_their_ends(spark):
    row = spark.range(1).select(*[f(F.lit(999), 1.0, 10, 1000, 0.1).alias(k) for k, f in optim.SCHEDULES.items()]).first()
    assert row.constant == 1 and abs(row.cosine - 0.1) < 1e-3 and abs(row.linear - 0.1) < 1e-2 and 0.1 <= row.wsd < 0.2
