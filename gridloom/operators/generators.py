"""Generated matrices and meshes as relations. Nothing is built on the driver but offset tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _offsets(points: int) -> list[tuple[int, int, int]]:
    return [o for o in product((-1, 0, 1), repeat=3) if points == 27 or sum(map(abs, o)) <= 1]


def grid_rows(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(i, ix, iy, iz) of a box, x fastest."""
    i = F.col("id")
    return spark.range(nx * ny * nz).select(i.alias("i"), (i % nx).alias("ix"), (F.floor(i / nx) % ny).alias("iy"), F.floor(i / (nx * ny)).alias("iz"))


def offset_matrix(spark: SparkSession, nx: int, ny: int, nz: int, entries: list[tuple[int, int, int, float]]) -> DataFrame:
    """(i, j, v): a row's neighbours at the given offsets, clipped to the box."""
    off = F.broadcast(spark.createDataFrame(entries, "dx int, dy int, dz int, v double"))  # 27 rows
    inside = (F.col("ix") + F.col("dx")).between(0, nx - 1) & (F.col("iy") + F.col("dy")).between(0, ny - 1) & (F.col("iz") + F.col("dz")).between(0, nz - 1)
    m = grid_rows(spark, nx, ny, nz).crossJoin(off).where(inside)
    return m.select("i", (F.col("i") + F.col("dx") + nx * (F.col("dy") + ny * F.col("dz"))).alias("j"), "v")


def stencil(spark: SparkSession, nx: int, ny: int, nz: int, points: int = 27, diag: float | None = None) -> DataFrame:
    """Diagonal `points` (or diag), -1 beside it."""
    d = float(points if diag is None else diag)
    return offset_matrix(spark, nx, ny, nz, [(*o, d if o == (0, 0, 0) else -1.0) for o in _offsets(points)])


def convection_diffusion(spark: SparkSession, nx: int, ny: int, nz: int, conv: float = 1.0) -> DataFrame:
    """7 points; -1 - conv/2 towards smaller, -1 + conv/2 towards larger coordinates."""
    h = conv / 2
    return offset_matrix(spark, nx, ny, nz, [(*o, 7.0 if not any(o) else -1.0 - h if sum(o) < 0 else -1.0 + h) for o in _offsets(7)])


def chimney(spark: SparkSession, nx: int, ny: int, nz: int, ranks: int, points: int = 27) -> DataFrame:
    """Boxes of `ranks` owners stacked along z, connected; the diagonal is always 27. Adds rank."""
    a = stencil(spark, nx, ny, nz * ranks, points, 27.0)
    return a.withColumn("rank", F.floor(F.col("i") / (nx * ny * nz)))


def row_sums(a: DataFrame) -> DataFrame:
    """b = A 1."""
    return a.groupBy("i").agg(F.sum("v").alias("b"))


def hashed_spd(spark: SparkSession, n: int) -> DataFrame:
    """A dense symmetric positive definite matrix: half of G + G' with G in [0, 1) by a fixed rule,
    and 20 n on the diagonal."""
    i, j = F.col("i"), F.col("j")
    g = lambda a, b: ((a * 7919 + b * 104729 + a * b * 31) % 1009) / F.lit(1009.0)
    ij = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    return ij.select("i", "j", (0.5 * (g(i, j) + g(j, i)) + F.when(i == j, 20.0 * n).otherwise(0.0)).alias("v"))


def hex_nodes(spark: SparkSession, s: int, edge: float = 1.125) -> DataFrame:
    """(n, ix, iy, iz, x, y, z) of the (s + 1)^3 nodes of a cube."""
    at = lambda c: (F.lit(edge) * F.col(c) / s)
    g = grid_rows(spark, s + 1, s + 1, s + 1).withColumnRenamed("i", "n")
    return g.select("n", "ix", "iy", "iz", at("ix").alias("x"), at("iy").alias("y"), at("iz").alias("z"))


def hex_corners(spark: SparkSession, s: int) -> DataFrame:
    """(e, c, n): the eight node ids of each element, counter-clockwise below, then above."""
    w = s + 1
    low = F.col("ix") + w * (F.col("iy") + w * F.col("iz"))
    ids = [low, low + 1, low + w + 1, low + w]
    ids += [x + w * w for x in ids]
    return grid_rows(spark, s, s, s).select(F.col("i").alias("e"), F.posexplode(F.array(*ids)).alias("c", "n"))


def hex_neighbours(spark: SparkSession, s: int) -> DataFrame:
    """(e, lxim, lxip, letam, letap, lzetam, lzetap): linear face neighbours, clamped to the element
    itself at the two ends of the numbering."""
    e, last = F.col("e"), s**3 - 1
    out = [e]
    for name, d in (("lxi", 1), ("leta", s), ("lzeta", s * s)):
        out += [F.when(e >= d, e - d).otherwise(e).alias(f"{name}m"), F.when(e + d <= last, e + d).otherwise(e).alias(f"{name}p")]
    return spark.range(s**3).select(F.col("id").alias("e")).select(*out)


def hex_boundary(spark: SparkSession, s: int) -> DataFrame:
    """(e, bc): bit flags of faces; symmetry (1, 8, 64) on the least, free (4, 32, 256) on the
    greatest coordinate of x, y and z. The bits are places of a three-bit field for each face pair."""
    bc = F.lit(0)
    for k, c in enumerate(("ix", "iy", "iz")):
        bc = bc.bitwiseOR(F.when(F.col(c) == 0, 1 << (3 * k)).otherwise(0)).bitwiseOR(F.when(F.col(c) == s - 1, 4 << (3 * k)).otherwise(0))
    return grid_rows(spark, s, s, s).select(F.col("i").alias("e"), bc.cast("long").alias("bc"))
