"""Running numbers and sums over null, negative, equal and outlying keys."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import loader, ordering, telemetry, tokens, vectors

KEYS = [None, None, -5, -5, 0, 3, 3, 3, 10**15, 7, 8, 9, *range(20, 60)]


def order(k):
    return (k is not None, k or 0)


@pytest.fixture(scope="module")
def rows(spark):
    r = [("a" if i % 3 else None, k, float(i), i % 5) for i, k in enumerate(KEYS)]
    return spark.createDataFrame(r, "s string, k long, v double, n long").repartition(3)


def test_every_row_is_numbered_once(rows):
    got = ordering.accumulated(rows, ["k"], ["s"], {"before": F.col("n")}, block=4).collect()
    assert len(got) == len(KEYS)
    for s in ("a", None):
        own = sorted((r for r in got if r.s == s), key=lambda r: r._k)
        assert [r._k for r in own] == list(range(len(own))) and {r._n for r in own} == {len(own)}
        assert [r.k for r in own] == sorted((r.k for r in own), key=order)
        assert [r.before for r in own] == [sum(x.n for x in own[:i]) for i in range(len(own))]


@pytest.mark.parametrize("keys", [[7] * 4000, [*range(4000), 10**15], [-(10**15), *range(4000)], [None] * 3000 + [*range(1000)]])
def test_blocks_are_even_whatever_the_keys(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    sizes = [r["count"] for r in ordering.ranged(df, ["k"], block=500)[0].groupBy("_b").count().collect()]
    assert sum(sizes) == len(keys) and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert sorted(r._k for r in ordering.accumulated(df, ["k"], block=500).select("_k").collect()) == list(range(len(keys)))


def test_null_keys_stay_in_streams_splits_pointers_and_series(spark, rows):
    t = tokens.stream(rows, "k", "n", block=4).collect()
    assert len(t) == len(KEYS) and max(r.base + r.n for r in t) == sum(r.n for r in t)
    parts = loader.split(rows, "k", 7, block=4).groupBy("rank").count().collect()
    assert [r["count"] for r in sorted(parts, key=lambda r: r.rank)] == [8] * 6 + [len(KEYS) - 48]
    a = spark.createDataFrame([(None, 0), (None, 1), (2, 0)], "i long, j long")
    p = vectors.row_pointers(a, spark.createDataFrame([(None,), (1,), (2,), (5,)], "i long"), block=2).collect()
    assert sorted(((r.i, r.start, r["count"]) for r in p), key=lambda r: order(r[0])) == [(None, 0, 2), (1, 2, 0), (2, 2, 1), (5, 3, 0)]
    for f in (lambda: telemetry.moving_average(rows, "v", ["k"], ["s"], 2, block=5), lambda: telemetry.sliding_zscore(rows, "v", ["k"], ["s"], 4, block=5), lambda: telemetry.since_last(rows, "k", ["k"], ["s"], block=5)):
        assert f().count() == len(KEYS)
    ema = {r.s: r.steps for r in telemetry.bias_corrected_ema(rows, "v", ["k"], ["s"], block=4).collect()}
    assert ema == {"a": sum(i % 3 > 0 for i in range(len(KEYS))) - 1, None: sum(i % 3 == 0 for i in range(len(KEYS))) - 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, n long")
    assert ordering.accumulated(none, ["k"]).collect() == []
    assert tokens.stream(none, "k", "n").collect() == []
    assert loader.split(none, "k", 3).collect() == []
