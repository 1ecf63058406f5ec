import math
import random

import pytest

from gridloom.operators import telemetry
from gridloom.plans import streams
from gridloom.streaming import detector, logs


def test_stream_gives_the_batch_scores(spark, tmp_path):
    rows = [(k % 2, k, float((k * 37) % 101)) for k in range(400)]
    df = spark.createDataFrame(rows, "s long, k long, v double")
    for i, lo in enumerate((0, 150, 310, 400)[:-1]):
        df.where(f"k >= {lo} and k < {(150, 310, 400)[i]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = detector.scores(stream, "s", "k", "v", 64).writeStream.format("memory").queryName("scores").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.k: None if r.z is None or math.isnan(r.z) else r.z for r in spark.table("scores").collect()}
    want = {r.k: r.z for r in telemetry.sliding_zscore(df, "v", ["k"], ["s"], 64).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def lines():
    """(stream, step, line, value): replays, steps out of order, nulls."""
    rows, n = [], 0
    for steps in (range(0, 40), range(25, 60), range(10, 12), [None, 2500, None]):
        for s in steps:
            for name in ("trl", "tel", None):
                rows.append((name, s, n, n / 8))
                n += 1
    return rows


def stream_of(spark, tmp, schema, batches):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")


@pytest.mark.parametrize("seed", [1, 2])
def test_last_lines_in_any_cut_and_order(spark, tmp_path, seed):
    logs.with_store(spark)
    rows, schema = lines(), "stream string, step long, line long, value double"
    rng = random.Random(seed)
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    df = logs.last_lines(stream_of(spark, tmp_path, schema, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]), "stream", "step", "line", "value")
    got = streams._broken_run(df, "update").collect()
    want = {}
    for name, step, line, value in sorted(rows, key=lambda r: r[2]):
        want[name, step] = (line, value)
    last = {}
    for r in sorted(got, key=lambda r: r.line):
        last[r.stream, r.step] = (r.line, r.value)
    assert last == want
    assert {(r.stream, r.step): r.value for r in telemetry.last_write(spark.createDataFrame(rows, schema), ["stream", "step"], "value", "line").collect()} == {k: v for k, (_, v) in want.items()}


def test_averages_equal_the_batch_form(spark, tmp_path):
    logs.with_store(spark)
    rows = [(None if k % 3 == 2 else k % 3, k, float((k * 37) % 101)) for k in range(150)] + [(7, 500, 1.0)]
    schema = "s long, k long, v double"
    parts = [rows[:40], list(reversed(rows[40:47])), rows[47:]]
    got = streams._broken_run(logs.averages(stream_of(spark, tmp_path, schema, parts), "s", "k", "v"), "append").collect()
    assert len(got) == len(rows)
    for r in telemetry.bias_corrected_ema(spark.createDataFrame(rows, schema), "v", ["k"], ["s"]).collect():
        last = max((x for x in got if x.s == r.s), key=lambda x: x.k)
        assert last.steps == r.steps and abs(last.ema - r.ema) < 1e-9
    assert [x.ema for x in got if x.s == 7] == [None]


def test_series_share_the_states_of_few_keys(spark, tmp_path, monkeypatch):
    logs.with_store(spark)
    monkeypatch.setattr(logs, "BUCKETS", 2)
    rows = [(s, k, float(s + k)) for k in range(4) for s in range(30)]
    arriving = stream_of(spark, tmp_path, "s long, k long, v double", [rows[:60], rows[60:]])
    got = streams._broken_run(logs.averages(arriving, "s", "k", "v"), "append")
    assert sorted((r.s, r.k, r.steps) for r in got.collect()) == sorted((s, k, k) for s, k, _ in rows)
