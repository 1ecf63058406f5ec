"""Regions, row files, user-defined reductions and updates, laid-out matrices, stochastic rounding."""

import math
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import reductions, regions, sampling, vectors
from gridloom.sources import row_files


def test_regions_equal_a_plain_loop(spark):
    assert list(islice(regions.draws(0), 3)) == [1804289383, 846930886, 1681692777]  # the C library's first numbers
    n, size = 100_000, 30_000
    e = spark.range(n).select((F.col("id") * 3 - 50).alias("key"), F.lit(1).alias("domain_"))
    got = [(r.domain, r.element, r.region) for r in regions.assigned(e, "key", 11, 1, domain=size, block=9000).orderBy("key").collect()]
    want = []
    for domain in range(4):  # each domain draws from the same seed
        g, own, last = regions.draws(0), [], None
        while len(own) < size:
            while True:
                x, i = next(g) % 66, 0
                while x >= (i + 1) * (i + 2) // 2:
                    i += 1
                region = (i + domain) % 11 + 1
                if region != last:
                    break
            kind = next(g) % 1000
            least, most = next((a, m) for below, a, m in [(773, 1, 15), (937, 16, 16), (970, 32, 32), (974, 64, 64), (978, 128, 128), (981, 256, 256), (1000, 512, 1537)] if kind < below)
            own += [region] * (least + next(g) % most)
            last = region
        want += [(domain, k, r) for k, r in enumerate(own[:size])]
    assert got == want[:n]
    assert regions.runs(5, 1) == [(0, 5)] and regions.runs(0, 3) == []


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_row_files_give_the_matrix_back(spark, tmp_path, parts):
    rows = [(i, j, i + j / 8 - 3) for i in range(20) for j in range(0, 20, i % 4 + 1) if i not in (5, 19)]
    a = spark.createDataFrame(rows, "i long, j long, v double")
    s = spark.createDataFrame([(i, 0.0, i / 4, 1.0) for i in range(20)], "i long, x double, b double, exact double")
    row_files.write(a, s, f"{tmp_path}/f", files=3)
    f = row_files.read(spark, f"{tmp_path}/f", parts)
    assert f.n == 20 and sorted((r.i, r.j, r.v) for r in f.matrix.collect()) == sorted(rows)
    assert sorted((r.i, r.x, r.b, r.exact) for r in f.sides.collect()) == [(i, 0.0, i / 4, 1.0) for i in range(20)]
    q, r = divmod(20, parts)
    want = [(k, k * q + min(k, r), q + (k < r)) for k in range(parts)]
    assert sorted((b.block, b.first, b.rows) for b in f.blocks.select("block", F.col("first"), "rows").collect()) == want
    assert sum(b.entries for b in f.blocks.collect()) == len(rows)


def test_row_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(row_files, "LINES", 100)
    rows = [(i, i * 7 % 300, float(i)) for i in range(300)]
    s = spark.range(300).select(F.col("id").alias("i"), F.lit(0.0).alias("x"), F.lit(1.0).alias("b"), F.lit(1.0).alias("exact"))
    row_files.write(spark.createDataFrame(rows, "i long, j long, v double"), s, f"{tmp_path}/f")
    lines = [len(f.read_text().splitlines()) for f in sorted((tmp_path / "f").glob("part-*"))]
    assert len(lines) == 10 and sum(lines) == 901 and max(lines) < 250
    f = row_files.read(spark, f"{tmp_path}/f", 3)
    assert sorted((r.i, r.j, r.v) for r in f.matrix.collect()) == rows


@pytest.mark.parametrize("text", ["", "2 1\n1\n0\n1 5.0 0\n0\n0 1 1\n", "2 2\n1\n0\n1 5.0 0\n0\n0 1 1\n0 0 1\n", "2 1\n1\n0\n1 5.0\n0\n0 1 1\n0 0 1\n", "1 1\n1\n2 5.0 0 1.0 1\n0 1 1\n"])
def test_row_files_that_do_not_add_up_are_refused(spark, tmp_path, text):
    (tmp_path / "f.txt").write_text(text)
    with pytest.raises(ValueError):
        row_files.read(spark, f"{tmp_path}/f.txt")
    (tmp_path / "g.txt").write_text("2 1\n1\n0\n1 5.0 0\n0\n0 1 1\n0 0 1\n")
    assert [tuple(r) for r in row_files.read(spark, f"{tmp_path}/g.txt").matrix.collect()] == [(0, 0, 5.0, 0)]


@pytest.mark.parametrize(("fan", "held"), [(2, 1), (64, 100_000)])
def test_reductions_equal_one_pass(spark, fan, held):
    rng = np.random.default_rng(5)
    rows = [(None if i % 5 == 0 else "k" if i % 5 < 4 else f"r{i % 35}", i % 2, None if i % 11 == 0 else float(x)) for i, x in enumerate(rng.normal(size=700) * 9)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(7)
    for by in (["a"], ["a", "b"], []):
        groups = {}
        for r in rows:
            if r[2] is not None:
                groups.setdefault(tuple(r["ab".index(c)] for c in by), []).append(r[2])
        for how in (reductions.TOTAL, reductions.LARGEST, reductions.ONLINE_SOFTMAX):
            got = {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in reductions.reduced(df, by, ["v"], how, fan, held).collect()}
            assert got.keys() == groups.keys()
            for k, v in groups.items():
                want = {"total": (math.fsum(v),), "largest": (max(v),), "m": (max(v), math.fsum(math.exp(x - max(v)) for x in v))}[how.names[0]]
                assert np.allclose(got[k], want, rtol=1e-10, atol=1e-9)
    none = reductions.reduced(df.where("false"), ["a"], ["v"], reductions.TOTAL)
    assert none.collect() == []


def test_block_updates_keep_their_shape(spark):
    df = spark.createDataFrame([(i // 4, float(i)) for i in range(10)], "block long, p double")
    assert sorted(r.p for r in reductions.updated_blocks(df, "block", ["p"], lambda k, p: [p - p.sum() if k else p]).collect())[-1] == 3.0
    with pytest.raises(Exception):
        reductions.updated_blocks(df, "block", ["p"], lambda k, p: [p[:1]]).collect()


def test_products_by_a_laid_out_matrix_do_not_shuffle_it(spark):
    a = spark.range(4000).select((F.col("id") % 50).alias("i"), (F.col("id") % 97).alias("j"), F.lit(1.5).alias("v"))
    x = spark.range(97).select(F.col("id").alias("i"), (F.col("id") * 0.5).alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        y = vectors.spmv(vectors.laid_out(a, "j", 8), x, "x")
        plan = y._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, y.collect())) == sorted(map(tuple, vectors.spmv(a, x, "x").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange") == 1 and "Bucketed: true" in join  # the vector's


def test_stochastic_rounding_equals_numpy_bit_for_bit(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-44, 38, 3000), [0.0, -0.0, 1.0, 2.0**-149, 2.0**-126, 3.4e38, -3.4e38, 2.0**100]]).astype(np.float32)
    r = rng.integers(0, 1 << 32, len(v))
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, r))], "i long, v double, r long")
    got = np.array([x.y for x in sampling.rounded_bf16(df, F.col("v"), F.col("r"), "y").orderBy("i").collect()])
    from gridloom.sources.binary_files import from_bf16

    want = from_bf16(sampling.stochastic_bf16(v, r)).astype(np.float64)
    assert np.array_equal(got, want), np.flatnonzero(got != want)[:5]
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "v double")
    odd = sampling.rounded_bf16(odd, F.col("v"), F.lit(0), "y").collect()
    assert odd[0].y is None and odd[1].y == math.inf and math.isnan(odd[2].y)
    n, x = 20_000, 1.2345678
    mean, dev = sampling.rounded_bf16(spark.range(n), F.lit(x), sampling.noise(F.col("id"), F.lit(3)), "y").agg(F.avg("y"), F.stddev("y")).first()
    assert abs(mean - float(np.float32(x))) < 3 * dev / math.sqrt(n)
