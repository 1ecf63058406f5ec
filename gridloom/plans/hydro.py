"""Queries of the hydrodynamics step and of the elementwise vector kernels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import hydro, vectors
from ..session import table
from .catalog import query

ELEMENTS = "SELECT o_orderkey AS e, o_custkey % 11 AS region, 1.0::DOUBLE + o_orderkey % 97 / 8.0::DOUBLE AS ss, CASE WHEN o_custkey % 11 = 3 THEN 0.0::DOUBLE ELSE (o_orderkey % 64 - 32) / 16.0::DOUBLE END AS vdov, (1.0::DOUBLE + o_custkey % 31) / 32.0::DOUBLE AS length FROM orders"


def _elements(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    vdov = F.when(c % 11 == 3, 0.0).otherwise((k % 64 - 32) / F.lit(16.0))
    return table(spark, sf_dir, "orders").select(k.alias("e"), (c % 11).alias("region"), (1.0 + k % 97 / F.lit(8.0)).alias("ss"), vdov.alias("vdov"), ((1.0 + c % 31) / F.lit(32.0)).alias("length"))


LIMITS = f"""WITH e AS ({ELEMENTS}), t AS (SELECT *, CASE WHEN vdov <> 0 THEN length / sqrt(ss * ss + CASE WHEN vdov < 0 THEN 256.0::DOUBLE * length * length * vdov * vdov ELSE 0 END) END AS a,
    CASE WHEN vdov <> 0 THEN 0.1::DOUBLE / (abs(vdov) + 1e-20::DOUBLE) END AS b FROM e),
  m AS (SELECT region, min(a) AS a, min(b) AS b FROM t GROUP BY region)
SELECT m.region, coalesce(round(m.a, 9), 1e20::DOUBLE) AS courant, min(e) FILTER (t.a = m.a) AS courant_e, coalesce(round(m.b, 9), 1e20::DOUBLE) AS hydro, min(e) FILTER (t.b = m.b) AS hydro_e
FROM m JOIN t USING (region) GROUP BY m.region, m.a, m.b"""


@query("H22 A08", LIMITS)
def region_time_limits(spark, sf_dir):
    out = hydro.region_limits(_elements(spark, sf_dir))
    return out.withColumns({"courant": F.round("courant", 9), "hydro": F.round("hydro", 9)})


@query("A09", f"SELECT region, count(*) AS elements, min(e) AS first_e, max(e) AS last_e FROM ({ELEMENTS}) GROUP BY region")
def region_sizes(spark, sf_dir):
    return _elements(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("elements"), F.min("e").alias("first_e"), F.max("e").alias("last_e"))


@query("H01 H24")
def time_increment(spark, sf_dir):
    """The clock from the tightest limits of all regions until the stop time; scalars of the driver, at most one a step."""
    worst = hydro.region_limits(_elements(spark, sf_dir)).agg(F.min("courant").alias("courant"), F.min("hydro").alias("hydro")).first()
    c, steps = hydro.Clock(dt=1.0e-4, courant=worst["courant"], hydro=worst["hydro"]), []
    while c.time < hydro.C.stoptime and c.cycle < 1000:
        c = replace(hydro.advance(c), courant=worst["courant"], hydro=worst["hydro"])
        steps.append((c.cycle, c.time, c.dt))
    return spark.createDataFrame(steps, "cycle long, time double, dt double")


@query("H02 H20", "SELECT l_orderkey, l_linenumber, -l_discount - l_tax AS stress, l_quantity * 1e11::DOUBLE > 1e12::DOUBLE AS beyond FROM lineitem")
def stress_and_stop(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", (F.col("l_quantity") * 1e11).alias("q"))
    return t.select("l_orderkey", "l_linenumber", hydro.stress(F.col("l_discount"), F.col("l_tax")).alias("stress"), (F.col("q") > hydro.C.qstop).alias("beyond"))


NODE = "p_partkey AS n, p_partkey % 5 / 4.0::DOUBLE AS x, p_partkey % 7 / 4.0::DOUBLE AS y, p_partkey % 3 / 4.0::DOUBLE AS z, (p_size - 25) / 8.0::DOUBLE AS f, 1.0::DOUBLE + p_size % 4 AS mass"


def _axis_sql(c: str) -> str:
    a = f"CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE f / mass END"
    return f"{a} AS {c}dd, CASE WHEN abs({a} * 0.0078125::DOUBLE) < 1e-7::DOUBLE THEN 0.0::DOUBLE ELSE {a} * 0.0078125::DOUBLE END AS {c}d"


@query("H10 H11 H12 E12", f"SELECT n, xdd, ydd, zdd, xd, yd, zd, x + xd * 0.0078125::DOUBLE AS x, y + yd * 0.0078125::DOUBLE AS y, z + zd * 0.0078125::DOUBLE AS z FROM (SELECT *, {', '.join(map(_axis_sql, 'xyz'))} FROM (SELECT {NODE} FROM part))")
def node_motion(spark, sf_dir):
    k = F.col("p_partkey")
    f = (F.col("p_size") - 25) / F.lit(8.0)
    t = table(spark, sf_dir, "part").select(k.alias("n"), (k % 5 / F.lit(4.0)).alias("x"), (k % 7 / F.lit(4.0)).alias("y"), (k % 3 / F.lit(4.0)).alias("z"), *[f.alias(f"f{c}") for c in "xyz"], *[F.lit(0.0).alias(f"{c}d") for c in "xyz"], (1.0 + F.col("p_size") % 4).alias("mass"))
    return hydro.move(hydro.accelerate(t), 0.0078125).select("n", *[f"{c}{s}" for s in ("dd", "d", "") for c in "xyz"])


@query("H17", "SELECT l_orderkey, l_linenumber, round(v, 9) AS vdov, round(a - v / 3.0::DOUBLE, 9) AS dxx, round(b - v / 3.0::DOUBLE, 9) AS dyy, round(c - v / 3.0::DOUBLE, 9) AS dzz FROM (SELECT *, l_quantity AS a, l_discount AS b, -l_tax AS c, l_quantity + l_discount + -l_tax AS v FROM lineitem)")
def strain_deviators(spark, sf_dir):
    parts = hydro.deviators(F.col("l_quantity"), F.col("l_discount"), -F.col("l_tax"))
    named = [F.round(p, 9).alias(n) for p, n in zip(parts, ("vdov", "dxx", "dyy", "dzz"))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *named)


@query("E01 E02 E03 E04 E05 E06 E07 E08 E13", "SELECT l_orderkey, l_linenumber, x AS copied, x * y AS product, 0.5::DOUBLE * y AS scaled, y + 0.25::DOUBLE * x AS plus, y - 0.25::DOUBLE * x AS minus, x + 0.5::DOUBLE * y AS xpby, 2.0::DOUBLE * x + 0.5::DOUBLE * y AS waxpby, x / 4.0::DOUBLE AS quotient, least(greatest(x, 10.0::DOUBLE), 40.0::DOUBLE) AS clamped FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y FROM lineitem)")
def vector_kernels(spark, sf_dir):
    x, y = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", x.alias("copied"), vectors.vmul(x, y).alias("product"), vectors.scal(0.5, y).alias("scaled"),
        vectors.axpy(y, 0.25, x).alias("plus"), vectors.axpy(y, 0.25, x, -1).alias("minus"), vectors.xpby(x, 0.5, y).alias("xpby"),
        vectors.waxpby(2.0, x, 0.5, y).alias("waxpby"), (x / 4.0).alias("quotient"), vectors.clamp(x, 10.0, 40.0).alias("clamped"))
