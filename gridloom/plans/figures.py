"""Queries of tile products and factors, diagonals, seeded draws and figures of runs and devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cholesky, optim, sampling, telemetry, vectors
from ..session import table
from .catalog import query
from .tensors import _LL, _x

TS = 16


@query("J10 F01 F02 F03 F04 F05", f"SELECT l.i, r.i AS j, round(sum(l.v * r.v) + CASE WHEN l.i = r.i THEN 1 ELSE 0 END, 4) AS v FROM {_LL} l JOIN {_LL} r ON l.vec_id = r.vec_id AND l.i >= r.i GROUP BY l.i, r.i")
def tile_factors(spark, sf_dir):
    """Products of the embeddings' columns, by tiles, plus one on the diagonal; factored by tiles, and put together again from the factor's."""
    g = cholesky.from_tiles(cholesky.gram(cholesky.panels(_x(spark, sf_dir), "vec_id", "x", TS), TS), TS)
    a = g.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    low = cholesky.factor(cholesky.to_tiles(a, TS), 64 // TS, TS)
    back = cholesky.gram(low.select("bi", F.col("bj").alias("k"), "data"), TS, turned=True)
    return cholesky.from_tiles(back, TS).where("i >= j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", 4).alias("v"))


@query("A28 E09", "WITH n AS (SELECT count(*) AS n FROM part), a AS (SELECT l_orderkey % n + 1 AS i, l_partkey AS j, sum(l_quantity - 25)::DOUBLE AS v FROM lineitem, n GROUP BY 1, 2), d AS (SELECT p_partkey, coalesce(v, 0) AS d FROM part LEFT JOIN a ON i = p_partkey AND j = p_partkey) SELECT (SELECT n FROM n) AS rows, (SELECT count(*) FROM a) AS nnz, count(*) FILTER (d = 0) AS zeros, (SELECT count(*) FROM a) / (SELECT n FROM n) AS nnz_per_row FROM d")
def zero_diagonals(spark, sf_dir):
    """Line items as a square matrix of parts: rows without a diagonal or with 0 there, and entries a row."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i"))
    n = parts.agg(F.count(F.lit(1)).alias("n"))
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))  # one row
    a = lines.groupBy((F.col("l_orderkey") % F.col("n") + 1).alias("i"), F.col("l_partkey").alias("j")).agg(F.sum(F.col("l_quantity") - 25).cast("double").alias("v"))
    return vectors.zero_diagonals(a, parts)


_NEXT = ("xor(s, s >> 12)", "xor(s, (s::UHUGEINT % 549755813888 * 33554432)::UBIGINT)", "xor(s, s >> 27)")


def _stepped(rows: str) -> str:
    """SQL of rows (event_id, s) with s moved on by one draw."""
    for e in _NEXT:
        rows = f"(SELECT event_id, {e} AS s FROM {rows})"
    return rows


def _draws(n: int) -> str:
    rows, out = "(SELECT event_id, (event_id + 1)::UBIGINT AS s FROM events)", []
    for k in range(n):
        rows = _stepped(rows)
        out.append(f"SELECT event_id, {k}::BIGINT AS draw, (s::UHUGEINT * {sampling.STAR} % 18446744073709551616 // 4294967296)::BIGINT AS bits FROM {rows}")
    return " UNION ALL ".join(out)


@query("R01", f"SELECT event_id, draw, bits, (bits // 256) / 16777216.0::DOUBLE AS coin FROM ({_draws(3)})")
def seeded_draws(spark, sf_dir):
    """Three draws of a generator that each event seeds."""
    e = table(spark, sf_dir, "events").select("event_id", F.posexplode(sampling.drawn(F.col("event_id") + 1, 3)).alias("draw", "d"))
    return e.select("event_id", F.col("draw").cast("long").alias("draw"), F.col("d.u32").alias("bits"), F.col("d.f32").alias("coin"))


@query("K04", "WITH r AS (SELECT user_id, count(*) AS cycles, sum(abs(value)) AS seconds, 10 + user_id % 20 AS side, 1 + user_id % 8 AS ranks FROM events GROUP BY user_id) SELECT user_id, cycles, round(seconds * 1e6 / cycles / pow(side, 3), 5) AS grind, round(seconds * 1e6 / cycles / (pow(side, 3) * ranks), 5) AS overall, round(1000.0 / nullif(seconds * 1e6 / cycles / (pow(side, 3) * ranks), 0), 5) AS fom FROM r")
def run_figures(spark, sf_dir):
    """Each user's events as the cycles of a run: grind times and figure of merit."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("cycles"), F.sum(F.abs("value")).alias("seconds"))
    r = telemetry.figures_of_merit(r.withColumns({"side": 10 + F.col("user_id") % 20, "ranks": 1 + F.col("user_id") % 8}))
    return r.select("user_id", "cycles", *[F.round(c, 5).alias(c) for c in ("grind", "overall", "fom")])


#: Parameters, layers, channels, context and tokens a step of the model that the steps are of.
SIZES = (124_475_904, 12, 768, 1024, 524_288)
_PEAKS = ", ".join(
    f"({i}::BIGINT, '{d}', '{p}', " + (f"{optim.SERIES[s][p]}::DOUBLE * ({u}::DOUBLE / {optim.SERIES[s]['units']}::DOUBLE) * ({m}::DOUBLE / {optim.SERIES[s]['mhz']}::DOUBLE)" if p in optim.SERIES[s] else "NULL::DOUBLE") + ")"
    for i, (d, (s, u, m)) in enumerate(optim.DEVICES.items())
    for p in ("bf16", "fp16")
)


@query("O07", f"WITH p AS (SELECT * FROM (VALUES {_PEAKS}) t(k, device, precision, peak)) SELECT device, precision, count(*) AS steps, round(avg((6.0::DOUBLE * {SIZES[0]} + 6.0::DOUBLE * {SIZES[1]} * {SIZES[2]} * {SIZES[3]}) * {SIZES[4]} / (abs(value) + 0.5) / (peak * 1e12)), 6) AS utilisation FROM events JOIN p ON user_id % {len(optim.DEVICES)} = k AND precision = CASE WHEN event_id % 2 = 0 THEN 'bf16' ELSE 'fp16' END GROUP BY 1, 2")
def device_utilisation(spark, sf_dir):
    """Events as steps on every known device: the share of what it promises at each precision, null where nothing is known."""
    e = table(spark, sf_dir, "events")
    names = F.element_at(F.array(*map(F.lit, optim.DEVICES)), (F.col("user_id") % len(optim.DEVICES) + 1).cast("int"))
    e = e.select(names.alias("device"), F.when(F.col("event_id") % 2 == 0, "bf16").otherwise("fp16").alias("precision"), (F.abs("value") + 0.5).alias("seconds"))
    peaks = None
    for p in ("bf16", "fp16"):
        t = optim.promised_table(spark, p).withColumn("precision", F.lit(p))
        peaks = t if peaks is None else peaks.unionByName(t)
    work = optim.flops_per_token(*(F.lit(n).cast("double") for n in SIZES[:4])) * SIZES[4]
    share = work / F.col("seconds") / (F.col("tflops") * 1e12)
    return e.join(F.broadcast(peaks), ["device", "precision"]).groupBy("device", "precision").agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg(share), 6).alias("utilisation"))  # a row for each device and precision
