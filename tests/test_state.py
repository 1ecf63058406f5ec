"""Loader state, generators, noise, backward passes and training, by brute force and finite differences."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import layers, loader, sampling, train
from gridloom.operators.tokens import MersenneTwister
from gridloom.sources.binary_files import from_bf16


def test_gradients_equal_finite_differences():
    c = train.Config(vocabulary=11, context=5, layers=2, heads=2, channels=8)
    rng = np.random.default_rng(1)
    flat = train.initial(c) + rng.normal(0, 0.2, c.size())
    tok = rng.integers(0, 11, (3, 6))
    loss, g = train.gradient(flat, tok, c)
    assert 0 < loss < 3 * 5 * 20
    for i in rng.choice(c.size(), 250, replace=False).tolist():
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        numeric = (train.gradient(up, tok, c)[0] - train.gradient(down, tok, c)[0]) / 2e-5
        assert abs(numeric - g[i]) < 1e-4 * max(1, abs(g[i])), i


def test_training_is_that_of_one_process(spark):
    c = train.TINY
    rng = np.random.default_rng(2)
    tok = rng.integers(0, 4, (40, c.context + 1))
    rows = spark.createDataFrame([(x.tolist(),) for x in tok], "tok array<long>").repartition(3)
    log, flat = train.train(rows, c, 4)
    w, m, v = train.initial(c), np.zeros(c.size()), np.zeros(c.size())
    for step, (_, loss, norm) in enumerate(log, 1):
        total, g = train.gradient(w, tok, c)
        n = tok.shape[0] * c.context
        g = g / n
        assert abs(loss - total / n) < 1e-9 and abs(norm - math.sqrt((g * g).sum())) < 1e-9
        g = g * min(1, 1 / norm)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 1e-2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(w, flat, atol=1e-9) and log[-1][1] < log[0][1]
    made = train.generated(rows, c, 3, 10, flat).collect()
    assert len(made) == 40 and all(len(r.made) == 10 and r.prompt in tok[:, :3].tolist() for r in made)
    assert train.train(rows.limit(0), c, 2)[0] == []


def test_batches_drop_what_is_no_whole_row(spark):
    d = spark.createDataFrame([("a b c d e f g h i j",), ("a b",), (None,), ("a " * 18,)], "text string")
    assert sorted(len(r.tok) for r in train.batches_of(d, "text", train.TINY).collect()) == [9, 9, 9]


def test_loader_goes_on_from_any_step(spark):
    sizes, b, t = [140, 10, 100, 140], 4, 8
    for ranks in (1, 2):
        each = [(n - 1) // (b * t * ranks) for n in sizes]
        want, epoch = [], 0
        while len(want) < 40:
            want += [(epoch, s, k) for s, n in enumerate(each) for k in range(n)]
            epoch += 1
        for first in (0, 1, 7, 23):
            got = [tuple(r)[1:] for r in loader.cursor(spark, sizes, b, t, ranks, first, 9).orderBy("step").collect()]
            assert got == want[first : first + 9]
    tokens = spark.createDataFrame([(s, p, 1000 * s + p) for s, n in enumerate(sizes) for p in range(n)], "shard long, pos long, tok long")
    rows = loader.batches(tokens, loader.cursor(spark, sizes, b, t, 2, 0, 7), b, t, 2).collect()
    assert len(rows) == 7 * 2 * b * t
    for r in rows:
        assert r.input == 1000 * r.shard + r["sample"] * 2 * b * t + r["rank"] * b * t + r.row * t + r.t and r.target == r.input + 1
    assert loader.cursor(spark, [3, 4], b, t, 1, 0, 5).count() == 0


def test_permutations_come_from_one_generator(spark):
    got = loader.permuted(spark, 3, 4, 2, 42).orderBy("epoch", "place", "at").collect()
    g, order = MersenneTwister(42), range(3)
    for epoch in range(2):
        order = g.shuffled(order)  # the last epoch's order is shuffled on
        for place, shard in enumerate(order):
            for at, x in enumerate(g.permutation(4)):
                r = got[(epoch * 3 + place) * 4 + at]
                assert (r.epoch, r.place, r.shard, r["at"], r["sample"]) == (epoch, place, shard, at, x)


def test_normals_are_normal(spark):
    rows = sampling.normals(spark, range(40), 50).toPandas()
    assert abs(rows["normal"].mean()) < 0.08 and abs(rows["normal"].std() - 1) < 0.08 and rows["uniform"].between(0, 1).all()
    g = MersenneTwister(5)
    u = [(g.u32() & 0xFFFFFF) / 2**24 for _ in range(16)]
    z = rows[rows["seed"] == 5].sort_values("i")["normal"].to_numpy()
    assert abs(z[0] - math.sqrt(-2 * math.log(1 - u[0])) * math.cos(2 * math.pi * u[8])) < 1e-12


def noise(x, seed):
    m = (x * 0xD2A80A3F + seed) & 0xFFFFFFFF
    m ^= m >> 9
    m = (m + 0xA884F197) & 0xFFFFFFFF
    m ^= m >> 11
    m = (m * 0x6C736F4B) & 0xFFFFFFFF
    m ^= m >> 13
    m = (m + 0xB79F3ABB) & 0xFFFFFFFF
    m ^= m >> 15
    m = (m * 0x1B56C4F5) & 0xFFFFFFFF
    return m ^ (m >> 17)


def test_noise_and_stochastic_rounding(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 1 << 32, (300, 2))] + [(0, 0), (2**32 - 1, 2**32 - 1)]
    d = spark.createDataFrame(rows, "x long, s long")
    for r in d.select("x", "s", sampling.noise(F.col("x"), F.col("s")).alias("n")).collect():
        assert r.n == noise(r.x, r.s)
    values = np.full(20000, 1.0 + 2**-9, np.float32)
    random = np.array([noise(i, 7) for i in range(20000)])
    half = from_bf16(sampling.stochastic_bf16(values, random))
    assert set(np.unique(half)) <= {np.float32(1.0), np.float32(1.0 + 2**-7)} and abs(half.mean() - (1 + 2**-9)) < 3e-4


def test_attention_backward_equals_finite_differences(spark):
    rng = np.random.default_rng(4)
    n, size = 4, 3
    q, k, v, g = rng.normal(size=(4, n, size))

    def out(q, k, v):
        s = np.where(np.tril(np.ones((n, n), bool)), q @ k.T * 0.5, -np.inf)
        a = np.exp(s - s.max(1, keepdims=True))
        return a / a.sum(1, keepdims=True) @ v

    rows = [(0, 0, t, q[t].tolist(), k[t].tolist(), v[t].tolist(), g[t].tolist()) for t in range(n)]
    d = spark.createDataFrame(rows, "b long, h long, t long, q array<double>, k array<double>, v array<double>, dout array<double>")
    by_q, by_kv = layers.attention_backward(d, 0.5)
    got = {("q", r.t, r.c): r.dq for r in by_q.collect()}
    for r in by_kv.collect():
        got["k", r.t, r.c], got["v", r.t, r.c] = r.dk, r.dv
    for name, x in (("q", q), ("k", k), ("v", v)):
        for t in range(n):
            for c in range(size):
                keep = x[t, c]
                x[t, c] = keep + 1e-6
                up = (out(q, k, v) * g).sum()
                x[t, c] = keep - 1e-6
                down = (out(q, k, v) * g).sum()
                x[t, c] = keep
                assert abs((up - down) / 2e-6 - got[name, t, c]) < 1e-4


def test_series_run_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(s, int(k), float(v)) for s, n in (("a", 900), ("b", 3), (None, 400)) for k, v in zip(np.cumsum(rng.integers(1, 50, n)), rng.normal(size=n))]
    d = spark.createDataFrame(rows, "s string, k long, v double")
    from gridloom.operators import telemetry

    got = {(r.s, r.k): (r.z, r.avg) for r in telemetry.moving_average(telemetry.sliding_zscore(d, "v", ["k"], ["s"], 64, block=70), "v", ["k"], ["s"], 3, block=10).collect()}
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        own = sorted((k, v) for t, k, v in rows if t == s)
        v = np.array([x for _, x in own])
        for i, (k, _) in enumerate(own):
            z, avg = got[s, k]
            last = v[max(0, i - 63) : i + 1]
            assert (z is None) == (i < 64) and (z is None or abs(z - (v[i] - last.mean()) / last.std()) < 1e-9)
            assert abs(avg - np.mean([v[min(max(j, 0), len(v) - 1)] for j in range(i - 3, i + 4)])) < 1e-9
    assert telemetry.sliding_zscore(d.limit(0), "v", ["k"], ["s"]).count() == 0


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    from gridloom.operators import train

    seen, write = {}, train.stored

    def kept(df, what):
        seen.setdefault(what, df.rdd.getNumPartitions())
        return write(df, what)

    monkeypatch.setattr(train, "stored", kept)
    monkeypatch.setattr(train, "ROWS", 10)
    rows = spark.createDataFrame([([i % 32 for i in range(9)],)] * 40, "tok array<long>").coalesce(1)
    assert train.losses(rows, train.TINY, steps=1).count() == 1 and seen["training-rows"] == 5
