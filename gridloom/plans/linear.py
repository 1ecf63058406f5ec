"""Queries of sparse and dense linear algebra and of communication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cholesky, generators, halo, solvers, vectors
from ..session import stored, table
from ..sources import matrix_market
from .catalog import query

N = 6


def _duck_grid(nx: int, ny: int, nz: int) -> str:
    return f"SELECT id AS i, id % {nx} AS ix, (id // {nx}) % {ny} AS iy, id // {nx * ny} AS iz FROM (SELECT CAST(unnest(range(0, {nx * ny * nz})) AS BIGINT) AS id)"


def _duck_stencil(nx: int, ny: int, nz: int, where: str, value: str) -> str:
    one = "(SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS {0})"
    return f"""SELECT i, i + dx + {nx} * (dy + {ny} * dz) AS j, CAST({value} AS DOUBLE) AS v
      FROM ({_duck_grid(nx, ny, nz)}) g, {one.format('dx')} a, {one.format('dy')} b, {one.format('dz')} c
      WHERE ix + dx BETWEEN 0 AND {nx - 1} AND iy + dy BETWEEN 0 AND {ny - 1} AND iz + dz BETWEEN 0 AND {nz - 1} AND {where}"""


ZERO = "dx = 0 AND dy = 0 AND dz = 0"
SEVEN = "abs(dx) + abs(dy) + abs(dz) <= 1"
S27 = _duck_stencil(N, N, N, "true", f"CASE WHEN {ZERO} THEN 27 ELSE -1 END")
S7 = _duck_stencil(N, N, N, SEVEN, f"CASE WHEN {ZERO} THEN 7 ELSE -1 END")
CONV = _duck_stencil(N, N, N, SEVEN, f"CASE WHEN {ZERO} THEN 7.0 WHEN dx + dy + dz < 0 THEN -1.5 ELSE -0.5 END")
ONES = f"SELECT CAST(unnest(range(0, {N**3})) AS BIGINT) AS i, 1.0::DOUBLE AS x"


@query("J01 A01", "SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 4) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def spmv_orders_parts(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return vectors.spmv(a, x, "x").select("i", F.round("y", 4).alias("y"))


@query("S01 J18", S27)
def stencil27_matrix(spark, sf_dir):
    return generators.stencil(spark, N, N, N)


@query("S01 A02", f"SELECT i, sum(v) AS b, count(*) AS nnz FROM ({S7}) GROUP BY i")
def stencil7_rowsum(spark, sf_dir):
    return generators.stencil(spark, N, N, N, 7).groupBy("i").agg(F.sum("v").alias("b"), F.count(F.lit(1)).alias("nnz"))


@query("S02", CONV)
def convdiff_matrix(spark, sf_dir):
    return generators.convection_diffusion(spark, N, N, N)


@query("S04", "SELECT i, j, v, i // 27 AS rank FROM (" + _duck_stencil(3, 3, 9, SEVEN, f"CASE WHEN {ZERO} THEN 27 ELSE -1 END") + ")")
def chimney_matrix(spark, sf_dir):
    return generators.chimney(spark, 3, 3, 3, 3, 7)


@query("S06", "WITH g AS (SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j FROM range(0, 12) x(a), range(0, 12) y(b)) SELECT i, j, 0.5::DOUBLE * (((i * 7919 + j * 104729 + i * j * 31) % 1009) / 1009.0::DOUBLE + ((j * 7919 + i * 104729 + i * j * 31) % 1009) / 1009.0::DOUBLE) + CASE WHEN i = j THEN 240.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM g")
def spd_matrix(spark, sf_dir):
    return generators.hashed_spd(spark, 12)


MM = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS j, CAST(n_nationkey + 0.5 AS DOUBLE) AS v FROM nation WHERE n_nationkey >= n_regionkey"


@query("S03 U03 K01", f"WITH m AS ({MM}) SELECT i, j, v FROM m UNION ALL SELECT j, i, v FROM m WHERE i <> j")
def matrix_market_symmetric(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey >= n_regionkey")
    a = n.select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"), (F.col("n_nationkey") + 0.5).cast("double").alias("v"))
    return matrix_market.read(spark, matrix_market.write(a, 25, "symmetric"))


VEC = "SELECT l_orderkey AS i, l_linenumber AS k, l_quantity AS x, l_extendedprice AS y, l_tax AS d FROM lineitem"


@query(
    "E01 E02 E03 E04 E05 E06 E07 E12 E13",
    f"SELECT i, k, y AS copied, d * x AS vmul, 3.0::DOUBLE * y AS scal, y + 2.0::DOUBLE * x AS axpy, y - 2.0::DOUBLE * x AS axmy, x + 0.5::DOUBLE * y AS xpby, 1.5::DOUBLE * x + 0.25::DOUBLE * y AS waxpby, CASE WHEN abs(x) < 10 THEN 0.0::DOUBLE ELSE x END AS cut, greatest(5.0::DOUBLE, least(40.0::DOUBLE, x)) AS clamped FROM ({VEC})",
)
def vector_elementwise(spark, sf_dir):
    x, y, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    v = vectors
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("k"), y.alias("copied"), v.vmul(d, x).alias("vmul"), v.scal(3.0, y).alias("scal"), v.axpy(y, 2.0, x).alias("axpy"),
        v.axpy(y, 2.0, x, -1).alias("axmy"), v.xpby(x, 0.5, y).alias("xpby"), v.waxpby(1.5, x, 0.25, y).alias("waxpby"), v.cutoff(x, 10).alias("cut"), v.clamp(x, 5.0, 40.0).alias("clamped"),
    )


@query("A01 A03 A04 X02", "SELECT round(sum(l_quantity * l_tax), 3) AS dot, round(sqrt(sum((l_quantity - l_tax) * (l_quantity - l_tax)) / sum(l_quantity * l_quantity)), 9) AS rel_residual, max(abs(l_quantity - l_tax)) AS max_diff FROM lineitem")
def dot_norms(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("b"), F.col("l_tax").alias("ax"))
    return s.agg(F.round(F.sum(F.col("b") * F.col("ax")), 3).alias("dot"), F.round(F.sqrt(F.sum((F.col("b") - F.col("ax")) ** 2) / F.sum(F.col("b") * F.col("b"))), 9).alias("rel_residual"), F.max(F.abs(F.col("b") - F.col("ax"))).alias("max_diff"))


@query("A03", "SELECT 0.0::DOUBLE AS rel_residual, 0.0::DOUBLE AS rel_error")
def residual_report(spark, sf_dir):
    a = generators.stencil(spark, N, N, N)
    s = generators.row_sums(a).withColumn("x", F.lit(1.0)).withColumn("exact", F.lit(1.0))
    r = vectors.residual_norms(s.join(vectors.spmv(a, s, "x", "ax"), "i"), "ax", "b", "x", "exact")
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query("E09 E10 E11", f"WITH a AS ({S7}), d AS (SELECT i, sum(CASE WHEN i = j THEN v - 0.5 ELSE 0 END) AS d FROM a GROUP BY i) SELECT i, d, 1.0 / nullif(d, 0) AS inverse FROM d")
def diagonal_shift_inverse(spark, sf_dir):
    a = vectors.shift_diagonal(generators.stencil(spark, N, N, N, 7), 0.5)
    return vectors.diagonal(a, spark.range(N**3).withColumnRenamed("id", "i")).withColumn("inverse", F.try_divide(F.lit(1.0), F.col("d")))


@query("W04", "WITH c AS (SELECT o_orderkey AS i, count(l_orderkey) AS count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT i, CAST(coalesce(sum(count) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, count FROM c")
def csr_row_pointers(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"))
    return vectors.row_pointers(a, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")))


@query("W05", "SELECT i, j, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT l_orderkey AS i, l_partkey AS j FROM lineitem)")
def scatter_place(spark, sf_dir):
    return vectors.place_in_row(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).distinct())


@query("W14 W15", "SELECT o_orderkey AS i, (o_orderkey % 103) // 15 AS tile, CASE WHEN o_orderkey % 103 < 75 THEN (o_orderkey % 103) // 15 ELSE 5 + (o_orderkey % 103 - 75) // 14 END AS owner FROM orders")
def tiles_and_owners(spark, sf_dir):
    i = F.col("o_orderkey") % 103
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), vectors.block_of(i, 103, 7).alias("tile"), vectors.contiguous_owner(i, 103, 7).alias("owner"))


def _solved(name: str, sigma: float = 0.0, conv: bool = False, points: int = 27, **options):
    def run(spark, sf_dir):
        a = generators.convection_diffusion(spark, N, N, N) if conv else generators.stencil(spark, N, N, N, points)
        a = stored(vectors.shift_diagonal(a, sigma) if sigma else a, "matrix")
        return solvers.SOLVERS[name](a, generators.row_sums(a), **options).x.select("i", F.round("x", 5).alias("x"))

    run.__name__ = f"{name}_solve"
    return run


query("I01", ONES)(_solved("cg", iterations=14))
query("I02", ONES)(_solved("cr", iterations=14))
query("I03", ONES)(_solved("minres", sigma=2.5, points=7, iterations=40))
query("I04", ONES)(_solved("bicgstab", conv=True, iterations=14))
query("I05 I06", ONES)(_solved("gmres", conv=True, restarts=4, m=8, tolerance=1e-9))
query("I07 I08", ONES)(_solved("hpc_cg", max_iterations=16))


@query("F01 F02 F03 F04 F05", "WITH g AS (SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j FROM range(0, 12) x(a), range(0, 12) y(b)) SELECT i, j, round(0.5::DOUBLE * (((i * 7919 + j * 104729 + i * j * 31) % 1009) / 1009.0::DOUBLE + ((j * 7919 + i * 104729 + i * j * 31) % 1009) / 1009.0::DOUBLE) + CASE WHEN i = j THEN 240.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS v FROM g WHERE i >= j")
def cholesky_reconstruct(spark, sf_dir):
    low = stored(cholesky.from_tiles(cholesky.factor(cholesky.to_tiles(generators.hashed_spd(spark, 12), 4), 3, 4), 4).where("i >= j"), "factor")
    other = low.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return low.withColumnRenamed("j", "k").join(other, "k").where("i >= j").groupBy("i", "j").agg(F.round(F.sum(F.col("v") * F.col("w")), 6).alias("v"))


CHIMNEY = "(SELECT i, j, i // 27 AS rank FROM (" + _duck_stencil(3, 3, 9, "true", "1") + "))"


def _chimney(spark):
    a = generators.chimney(spark, 3, 3, 3, 3)
    return a, spark.range(3).select(F.col("id").alias("rank"), (F.col("id") * 27).alias("start_row"))


@query("J11 J12 X01", f"SELECT DISTINCT rank, j, j // 27 AS owner FROM {CHIMNEY} WHERE j // 27 <> rank")
def halo_externals(spark, sf_dir):
    a, starts = _chimney(spark)
    ext = halo.externals(a, a.select("rank", "i").distinct()).withColumnRenamed("rank", "dst")
    return halo.owners(ext, starts).select(F.col("dst").alias("rank"), "j", F.col("rank").alias("owner"))


@query("J13 U01", f"WITH e AS (SELECT DISTINCT rank, j FROM {CHIMNEY} WHERE j // 27 <> rank), x AS (SELECT rank AS dst, j // 27 AS src FROM e) SELECT DISTINCT dst AS rank, src AS neighbour FROM (SELECT dst, src FROM x UNION ALL SELECT src, dst FROM x)")
def halo_neighbours(spark, sf_dir):
    a, starts = _chimney(spark)
    return halo.neighbours(halo.exchange(halo.externals(a, a.select("rank", "i").distinct()), starts))


@query("J13", f"SELECT rank AS dst, j // 27 AS src, count(DISTINCT j) AS values FROM {CHIMNEY} WHERE j // 27 <> rank GROUP BY 1, 2")
def halo_exchange(spark, sf_dir):
    a, starts = _chimney(spark)
    return halo.exchange(halo.externals(a, a.select("rank", "i").distinct()), starts)


@query("J19", f"SELECT DISTINCT i // 36 AS block, j // 36 AS reads FROM ({S27})")
def block_dependencies(spark, sf_dir):
    return halo.block_dependencies(generators.stencil(spark, N, N, N), 36)


_WORK = {"cg": f"3 * {N**3} + 10 * (2 * m + 11 * {N**3})", "cr": f"2 * m + 2 * {N**3} + 10 * (2 * m + 13 * {N**3})", "minres": f"2 * {N**3} + 10 * (2 * m + 18 * {N**3})", "bicgstab": f"2 * {N**3} + 10 * (4 * m + 24 * {N**3})", "gmres": f"10 * (2 * m + 6 * {N**3} + 5 * (2 * m + 3 * {N**3}) + 15 * 4 * {N**3} + 4 * {N**3} + 5 * 2 * {N**3})", "hpc_cg": f"10 * (2 * m + 10 * {N**3})"}


@query("A24 F07 UX1", f"SELECT solver, CAST(flops AS DOUBLE) AS flops FROM (SELECT count(*) AS m FROM ({S27})), LATERAL (VALUES " + ", ".join(f"('{k}', ({v})::DOUBLE)" for k, v in _WORK.items()) + ", ('cholesky', 4096.0::DOUBLE * 64 / 3)) t(solver, flops)")
def flop_models(spark, sf_dir):
    m = generators.stencil(spark, N, N, N).agg(F.count(F.lit(1)).alias("m"))
    models = [F.struct(F.lit(k).alias("solver"), solvers.flops(k, F.col("m"), N**3, 10, restart=5).cast("double").alias("flops")) for k in _WORK]
    models.append(F.struct(F.lit("cholesky").alias("solver"), F.lit(float(cholesky.flops(64))).alias("flops")))
    return m.select(F.explode(F.array(*models)).alias("x")).select("x.*")
