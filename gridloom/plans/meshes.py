"""Queries of the hexahedral mesh and of its set-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generators, hexmesh
from ..session import scratch
from .catalog import query

S = 5
GRID = f"SELECT id AS e, id % {S} AS ix, (id // {S}) % {S} AS iy, id // {S * S} AS iz FROM (SELECT CAST(unnest(range(0, {S**3})) AS BIGINT) AS id)"
NODES = f"SELECT id AS n, id % {S + 1} AS ix, (id // {S + 1}) % {S + 1} AS iy, id // {(S + 1) ** 2} AS iz FROM (SELECT CAST(unnest(range(0, {(S + 1) ** 3})) AS BIGINT) AS id)"


@query("S07", f"SELECT n, 1.125::DOUBLE * ix / {S} AS x, 1.125::DOUBLE * iy / {S} AS y, 1.125::DOUBLE * iz / {S} AS z FROM ({NODES})")
def mesh_nodes(spark, sf_dir):
    return generators.hex_nodes(spark, S).select("n", "x", "y", "z")


@query("S07 M9 J16", f"SELECT e, CAST(c AS BIGINT) AS c, ix + CASE WHEN c % 4 IN (1, 2) THEN 1 ELSE 0 END + {S + 1} * (iy + CASE WHEN c % 4 >= 2 THEN 1 ELSE 0 END + {S + 1} * (iz + c // 4)) AS n FROM ({GRID}), (SELECT unnest(range(0, 8)) AS c)")
def mesh_corners(spark, sf_dir):
    return generators.hex_corners(spark, S).select("e", F.col("c").cast("long").alias("c"), "n")


@query("S08", f"SELECT e, CASE WHEN e >= 1 THEN e - 1 ELSE e END AS lxim, CASE WHEN e + 1 < {S**3} THEN e + 1 ELSE e END AS lxip, CASE WHEN e >= {S} THEN e - {S} ELSE e END AS letam, CASE WHEN e + {S} < {S**3} THEN e + {S} ELSE e END AS letap, CASE WHEN e >= {S * S} THEN e - {S * S} ELSE e END AS lzetam, CASE WHEN e + {S * S} < {S**3} THEN e + {S * S} ELSE e END AS lzetap FROM ({GRID})")
def mesh_neighbours(spark, sf_dir):
    return generators.hex_neighbours(spark, S)


@query("S09 M11", "SELECT e, CAST(" + " + ".join(f"CASE WHEN {c} = 0 THEN {1 << 3 * k} ELSE 0 END + CASE WHEN {c} = {S - 1} THEN {4 << 3 * k} ELSE 0 END" for k, c in enumerate(("ix", "iy", "iz"))) + f" AS BIGINT) AS bc FROM ({GRID})")
def mesh_bc_flags(spark, sf_dir):
    return generators.hex_boundary(spark, S)


@query("S10", f"SELECT axis, count(*) AS nodes FROM (SELECT n, unnest(CASE WHEN ix = 0 THEN ['x'] ELSE [] END || CASE WHEN iy = 0 THEN ['y'] ELSE [] END || CASE WHEN iz = 0 THEN ['z'] ELSE [] END) AS axis FROM ({NODES})) GROUP BY axis")
def symmetry_planes(spark, sf_dir):
    n = generators.hex_nodes(spark, S)
    planes = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c[1])) for c in ("ix", "iy", "iz")]), lambda v: v.isNotNull())
    return n.select(F.explode(planes).alias("axis")).groupBy("axis").agg(F.count(F.lit(1)).alias("nodes"))


def _elements(spark):
    e = hexmesh.gather(generators.hex_corners(spark, S), generators.hex_nodes(spark, S))
    return e.withColumn("volume", hexmesh.volume())


H = f"(1.125::DOUBLE / {S})"


@query("J02 H13 H14 H23", f"SELECT e, round({H} * {H} * {H}, 9) AS volume, round({H}, 9) AS length FROM ({GRID})")
def hex_volume_length(spark, sf_dir):
    return _elements(spark).select("e", F.round("volume", 9).alias("volume"), F.round(hexmesh.characteristic_length(F.col("volume")), 9).alias("length"))


@query("A07", f"SELECT n, round({H} * {H} * {H} / 8 * (CASE WHEN ix IN (0, {S}) THEN 1 ELSE 2 END) * (CASE WHEN iy IN (0, {S}) THEN 1 ELSE 2 END) * (CASE WHEN iz IN (0, {S}) THEN 1 ELSE 2 END), 7) AS mass FROM ({NODES})")
def nodal_mass(spark, sf_dir):
    return hexmesh.nodal_mass(generators.hex_corners(spark, S), _elements(spark)).select("n", F.round("mass", 7).alias("mass"))


@query("J14 A14", f"WITH e AS (SELECT ix AS j, iy AS k, (ix * iy + ix + iy) / 4.0::DOUBLE + CASE WHEN ix < iy THEN 0.001::DOUBLE ELSE 0 END AS v FROM ({GRID}) WHERE iz = 0) SELECT round(max(abs(a.v - b.v)), 9) AS max_diff, round(sum(abs(a.v - b.v)), 9) AS total_diff FROM e a JOIN e b ON a.j = b.k AND a.k = b.j AND a.j < a.k")
def plane_symmetry(spark, sf_dir):
    g = generators.grid_rows(spark, S, S, 1)
    e = g.select(F.col("ix").alias("j"), F.col("iy").alias("k"), ((F.col("ix") * F.col("iy") + F.col("ix") + F.col("iy")) / 4.0 + F.when(F.col("ix") < F.col("iy"), 0.001).otherwise(0.0)).alias("v"))
    m = e.select(F.col("k").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    d = F.abs(F.col("v") - F.col("w"))
    return e.join(m, ["j", "k"]).where("j < k").agg(F.round(F.max(d), 9).alias("max_diff"), F.round(F.sum(d), 9).alias("total_diff"))


@query("S07", f"SELECT e, CAST(c AS BIGINT) AS c, n, e % 11 AS material, 1.125::DOUBLE * (n % {S + 1}) / {S} AS x, 1.125::DOUBLE * (n // {S + 1} % {S + 1}) / {S} AS y, 1.125::DOUBLE * (n // {(S + 1) ** 2}) / {S} AS z FROM (SELECT e, c, CAST(ix + CASE WHEN c % 4 IN (1, 2) THEN 1 ELSE 0 END + {S + 1} * (iy + CASE WHEN c % 4 >= 2 THEN 1 ELSE 0 END + {S + 1} * (iz + c // 4)) AS BIGINT) AS n FROM ({GRID}), (SELECT unnest(range(0, 8)) AS c))")
def mesh_dump(spark, sf_dir):
    """Connectivity, places and materials written as three tables, and the mesh made of them again."""
    path = scratch(spark, "mesh")
    corners = generators.hex_corners(spark, S)
    corners.groupBy("e").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "n"))), lambda x: x["n"]).alias("nodes")).write.parquet(f"{path}/connectivity")  # eight each
    generators.hex_nodes(spark, S).select("n", "x", "y", "z").write.parquet(f"{path}/places")
    spark.range(S**3).select(F.col("id").alias("e"), (F.col("id") % 11).alias("material")).write.parquet(f"{path}/materials")
    part = lambda name: spark.read.parquet(f"{path}/{name}")
    c = part("connectivity").select("e", F.posexplode("nodes").alias("c", "n")).withColumn("c", F.col("c").cast("long"))
    return c.join(part("places"), "n").join(part("materials"), "e").select("e", "c", "n", "material", "x", "y", "z")
