"""Queries of regions, row files, user-defined reductions and updates, laid-out matrices and stochastic rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reductions, regions, sampling, vectors
from ..operators.ordering import accumulated
from ..session import scratch, table
from ..sources import row_files
from .catalog import query
from .state import _LL, _SQ
from .tensors import _x


@query("S11 A09")
def region_elements(spark, sf_dir):
    """Orders as elements, dealt to eleven regions in seeded runs: elements, first and last of each region of each domain."""
    e = regions.assigned(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 11, 1)
    return e.groupBy("domain", "region").agg(F.count(F.lit(1)).alias("n"), F.min("element").alias("first"), F.max("element").alias("last"), F.sum("o_orderkey").alias("keys"))


PARTS = 7


@query("S05 W15", f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), b AS (SELECT *, CASE WHEN i < (n % {PARTS}) * (n // {PARTS} + 1) THEN i // (n // {PARTS} + 1) ELSE (n % {PARTS}) + (i - (n % {PARTS}) * (n // {PARTS} + 1)) // greatest(n // {PARTS}, 1) END AS block FROM o),
e AS (SELECT i, block, l_partkey AS j, l_quantity::DOUBLE AS v FROM b JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT block, count(*) AS entries, round(sum(v * (1 + i % 13)), 3) AS sum, CAST(sum(j) AS BIGINT) AS columns FROM e GROUP BY block), r AS (SELECT i, sum(v) AS t FROM e GROUP BY i)
SELECT CAST(b.block AS BIGINT) AS block, CAST(min(b.i) AS BIGINT) AS first, count(*) AS rows, any_value(s.entries) AS entries, any_value(s.sum) AS sum, any_value(s.columns) AS columns, round(sum(coalesce(r.t, 0)), 3) AS sides FROM b LEFT JOIN s USING (block) LEFT JOIN r USING (i) GROUP BY b.block""")
def row_file(spark, sf_dir):
    """Line items as a matrix of orders by parts, written as a row file and read back in seven blocks of rows."""
    o = accumulated(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.col("_k").alias("i"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("long").alias("j"), F.col("l_quantity").cast("double").alias("v"))
    a = lines.join(o, "o_orderkey").select("i", "j", "v")
    b = a.groupBy("i").agg(F.sum("v").alias("b"))
    sides = o.join(b, "i", "left").select("i", F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("b"), F.lit(1.0).alias("exact"))
    path = scratch(spark, "row-file")
    row_files.write(a, sides, path)
    f = row_files.read(spark, path, PARTS)
    m = f.matrix.groupBy("block").agg(F.round(F.sum(F.col("v") * (1 + F.col("i") % 13)), 3).alias("sum"), F.sum("j").alias("columns"))
    s = f.sides.groupBy("block").agg(F.round(F.sum(F.col("b") * F.col("exact")), 3).alias("sides"))
    return f.blocks.join(m, "block", "left").join(s, "block").select("block", "first", "rows", "entries", "sum", "columns", "sides")


@query("UX3 UX4 ST3 W02", "SELECT l_returnflag, max(v) AS m, round(sum(exp(v - x)), 6) AS s FROM (SELECT l_returnflag, l_extendedprice::DOUBLE / 10000 AS v, max(l_extendedprice::DOUBLE / 10000) OVER (PARTITION BY l_returnflag) AS x FROM lineitem) GROUP BY l_returnflag")
def reduced_states(spark, sf_dir):
    """Online softmax as a user-defined reduction over three keys: states of tasks, merged in a tree."""
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice").cast("double") / 10000).alias("v"))
    return reductions.reduced(d, ["l_returnflag"], ["v"], reductions.ONLINE_SOFTMAX).select("l_returnflag", "m", F.round("s", 6).alias("s"))


@query("UX2", f"SELECT vec_id, i, round(p, 6) AS p, round(m, 6) AS m FROM (SELECT vec_id, i, v - (CASE WHEN vec_id // 50 % 2 = 0 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END) * (0.9::DOUBLE * v + v) AS p, 0.9::DOUBLE * v + v AS m FROM {_LL})")
def block_updates(spark, sf_dir):
    """A momentum step that a caller's function takes on blocks of fifty vectors, with a rate of each block's own."""

    def step(block, p, m):
        m = 0.9 * m + p
        return p - (0.1 if block % 2 == 0 else 0.01) * m, m

    x = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), "p", F.col("p").alias("m"), F.floor(F.col("vec_id") / 50).alias("block"))
    return reductions.updated_blocks(x, "block", ["p", "m"], step).select("vec_id", "i", F.round("p", 6).alias("p"), F.round("m", 6).alias("m"))


@query("J01", "SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 4) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def spmv_laid_out(spark, sf_dir):
    """The product of orders by parts over a matrix that lies in buckets of its columns."""
    a = vectors.laid_out(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")), "j", 16)
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return vectors.spmv(a, x, "x").select("i", F.round("y", 4).alias("y"))


_V = "l_extendedprice::FLOAT::DOUBLE"


@query("E17 R05", f"""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(xor(m, m >> 17) AS BIGINT) % 65536 AS r FROM (SELECT l_orderkey, l_linenumber, CAST(m AS BIGINT) AS m FROM ({_SQ[-1]}))),
v AS (SELECT l_orderkey, l_linenumber, {_V} AS v, floor(log2({_V})) AS e FROM lineitem), w AS (SELECT *, CAST(v * pow(2, 23 - e) AS BIGINT) AS w FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN v = 0 THEN 0 ELSE ((w >> 16) + CASE WHEN w % 65536 > r THEN 1 ELSE 0 END) * pow(2, e - 7) END AS rounded FROM w JOIN r USING (l_orderkey, l_linenumber)""")
def stochastic_rounding(spark, sf_dir):
    """Prices at half width, up or down by each line's own noise."""
    noise = sampling.noise(F.col("l_orderkey"), F.col("l_linenumber").cast("long"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sampling.rounded_bf16(lines, F.col("l_extendedprice"), noise, "rounded").select("l_orderkey", "l_linenumber", "rounded")
