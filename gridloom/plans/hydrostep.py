"""Queries of the explicit hydrodynamics step: its parts on meshes and fields whose results are known in
closed form, the state update on a table's rows, and whole cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generators, hexmesh, hexstep
from ..session import table
from .catalog import query
from .meshes import GRID, H, S

#: Corner signs along x, y and z, in SQL.
SX, SY, SZ = "(CASE WHEN c % 4 IN (1, 2) THEN 1 ELSE -1 END)", "(CASE WHEN c % 4 >= 2 THEN 1 ELSE -1 END)", "(CASE WHEN c >= 4 THEN 1 ELSE -1 END)"
CORNER = f"SELECT e, ix, iy, iz, CAST(c AS BIGINT) AS c, {SX} AS sx, {SY} AS sy, {SZ} AS sz FROM ({GRID}), (SELECT unnest(range(0, 8)) AS c)"


def _gathered(spark, xd="0.0", yd="0.0", zd="0.0"):
    """Elements of the mesh with corners' places and velocities, given as SQL over ix, iy, iz, x, y, z."""
    nodes = generators.hex_nodes(spark, S).withColumns({"xd": F.expr(f"double({xd})"), "yd": F.expr(f"double({yd})"), "zd": F.expr(f"double({zd})")})
    return hexmesh.gather(generators.hex_corners(spark, S), nodes, ("x", "y", "z", "xd", "yd", "zd"))


def _by_corner(e, compute, *scalars):
    """(e, c, x, y, z): a vector of each corner, rounded; scalars go along."""
    out = hexstep.kernel(e, compute, ("f",), scalars)
    flat = out.select("e", F.posexplode("f").alias("c", "v"), *scalars)
    return flat.select("e", F.col("c").cast("long").alias("c"), *[(F.round(F.col("v")[i], 9) + F.lit(0.0)).alias(x) for i, x in enumerate("xyz")], *[F.round(m, 9).alias(m) for m in scalars])


def _shape(b):
    f, det = hexstep.shape_derivatives(b["r"])
    return {"f": f, "det": det}


QUARTER = f"SELECT e, c, " + ", ".join(f"round({H} * {H} / 4 * s{x}, 9) AS {x}" for x in "xyz")  # noqa: F541


@query("H03", f"{QUARTER}, round({H} * {H} * {H}, 9) AS det FROM ({CORNER})")
def shape_derivatives(spark, sf_dir):
    return _by_corner(_gathered(spark), _shape, "det")


@query("H04", f"{QUARTER} FROM ({CORNER})")
def corner_normals(spark, sf_dir):
    return _by_corner(_gathered(spark), lambda b: {"f": hexstep.corner_normals(b["r"])})


@query("H07", f"{QUARTER} FROM ({CORNER})")
def volume_derivatives(spark, sf_dir):
    return _by_corner(_gathered(spark), lambda b: {"f": hexstep.volume_derivatives(b["r"])})


AT_NODE = f"SELECT ix + (sx + 1) // 2 + {S + 1} * (iy + (sy + 1) // 2 + {S + 1} * (iz + (sz + 1) // 2)) AS n, * FROM ({CORNER})"


@query("H05 H06 A06", f"SELECT CAST(n AS BIGINT) AS n, " + ", ".join(f"round(sum((1.0123::DOUBLE + e % 7 * 1.0371::DOUBLE) * {H} * {H} / 4 * s{x}), 6) + 0.0 AS f{x}" for x in "xyz") + f" FROM ({AT_NODE}) GROUP BY n")  # noqa: F541
def stress_at_nodes(spark, sf_dir):
    e = _gathered(spark).withColumns({"p": F.lit(1.0123), "q": F.col("e") % 7 * 1.0371})
    e = hexstep.kernel(e, lambda b: {"f": hexstep.stress_forces(b)}, ("f",))
    f = hexstep.node_forces(e, generators.hex_corners(spark, S))
    return f.select("n", *[(F.round(x, 6) + F.lit(0.0)).alias(x) for x in ("fx", "fy", "fz")])


# a velocity of ix * iy along x is twice the mode of the signs of x and y, and nothing of the others
@query("H08 H09", f"SELECT e, c, round(-0.06::DOUBLE * {H} * {H} * 2 * sx * sy, 9) + 0.0 AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM ({CORNER})")
def hourglass_forces(spark, sf_dir):
    cube = (1.125 / S) ** 3
    e = _gathered(spark, "ix * iy").withColumns({"volo": F.lit(cube), "v": F.lit(1.0), "ss": F.lit(2.0), "mass": F.lit(cube)})
    return _by_corner(e, lambda b: {"f": hexstep.hourglass_forces(b)})


LINEAR = ("0.1 * x", "-0.2 * y", "0.05 * z")
D = [f"({r}::DOUBLE / (1 - 0.25::DOUBLE * {r}::DOUBLE))" for r in (0.1, -0.2, 0.05)]


@query("H15 H16 H17", f"SELECT e, 1.0::DOUBLE AS vnew, 0.01::DOUBLE AS delv, round({H}, 9) AS arealg, round({D[0]}, 9) AS dxx, round({D[1]}, 9) AS dyy, round({D[2]}, 9) AS dzz, round({' + '.join(D)}, 9) AS vdov FROM ({GRID})")
def element_kinematics(spark, sf_dir):
    e = _gathered(spark, *LINEAR).withColumns({"volo": F.lit((1.125 / S) ** 3), "v": F.lit(0.99)})
    out = hexstep.kinematics(e, 0.5)
    return out.select("e", *[F.round(x, 9).alias(x) for x in ("vnew", "delv", "arealg", "dxx", "dyy", "dzz", "vdov")])


@query("H18", "SELECT e, " + ", ".join(f"round({H}, 9) AS delx_{a}, {r}::DOUBLE AS delv_{a}" for a, r in zip(hexstep.AXES, (0.1, -0.2, 0.05))) + f" FROM ({GRID})")
def monotonic_gradients(spark, sf_dir):
    e = _gathered(spark, *LINEAR).withColumns({"volo": F.lit((1.125 / S) ** 3), "v": F.lit(1.0)})
    return hexstep.kinematics(e, 0.5).select("e", *[F.round(f"{k}_{a}", 9).alias(f"{k}_{a}") for a in hexstep.AXES for k in ("delx", "delv")])


FIELD = {"delv_xi": "(e * 7 % 23 - 11) / 4.0", "delv_eta": "(e * 5 % 19 - 9) / 4.0", "delv_zeta": "(e * 3 % 17 - 8) / 8.0", "delx_xi": "0.5", "delx_eta": "0.25", "delx_zeta": "0.75", "vdov": "(e % 5 - 3) / 2.0", "mass": "2.0", "volo": "1.0 + e % 3", "vnew": "0.5"}


def _side(axis: str, sign: str, near: str, edge: str, beyond: str) -> str:
    return f"CASE WHEN {edge} THEN {beyond} ELSE (SELECT delv_{axis} FROM f AS g WHERE g.e = f.e {sign} {near}) END / (delv_{axis} + 1e-36::DOUBLE) AS {axis}_{'m' if sign == '-' else 'p'}"


_SIDES = ", ".join(f"{_side(a, '-', n, f'i{x} = 0', f'delv_{a}')}, {_side(a, '+', n, f'i{x} = {S - 1}', '0')}" for a, x, n in (("xi", "x", 1), ("eta", "y", S), ("zeta", "z", S * S)))
_PHI = ", ".join(f"least(greatest(least(0.5 * ({a}_m + {a}_p), 2 * {a}_m, 2 * {a}_p), 0), 1) AS phi_{a}, least(delv_{a} * delx_{a}, 0) AS in_{a}" for a in hexstep.AXES)
LIMITED = f"""WITH f AS (SELECT e, ix, iy, iz, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in FIELD.items())} FROM ({GRID})),
  s AS (SELECT *, {_SIDES} FROM f), p AS (SELECT *, {_PHI}, mass / (volo * vnew) AS rho FROM s)
SELECT e, round(CASE WHEN vdov > 0 THEN 0 ELSE -0.5::DOUBLE * rho * ({' + '.join(f'in_{a} * (1 - phi_{a})' for a in hexstep.AXES)}) END, 9) + 0.0 AS ql,
  round(CASE WHEN vdov > 0 THEN 0 ELSE 2.0::DOUBLE / 3 * rho * ({' + '.join(f'in_{a} * in_{a} * (1 - phi_{a} * phi_{a})' for a in hexstep.AXES)}) END, 9) + 0.0 AS qq FROM p"""


@query("H19 J03", LIMITED)
def monotonic_limiter(spark, sf_dir):
    e = spark.range(S**3).withColumnRenamed("id", "e").select("e", *[F.expr(f"double({v})").alias(k) for k, v in FIELD.items()])
    out = hexstep.limited(e, generators.hex_neighbours(spark, S), generators.hex_boundary(spark, S))
    return out.select("e", *[(F.round(x, 9) + F.lit(0.0)).alias(x) for x in ("ql", "qq")])


STATE = {"en": "l_quantity - 5", "p": "greatest((l_quantity - 5) / 2, 0)", "q": "l_tax", "v": "1.0 - l_discount", "vnew": "1.0 - l_discount + (l_linenumber - 3) / 63e0", "delv": "(l_linenumber - 3) / 63e0", "ql": "l_tax * 2", "qq": "l_discount / 4"}


def _press(energy: str, comp: str) -> str:
    raw = f"(2.0::DOUBLE / 3 * ({comp} + 1) * ({energy}))"
    return f"greatest(CASE WHEN abs{raw} < 1e-7::DOUBLE THEN 0 ELSE {raw} END, 0)"


def _speed(energy: str, p: str, comp: str, vol: str) -> str:
    s = f"(2.0::DOUBLE / 3 * {energy} + {vol} * {vol} * 2.0::DOUBLE / 3 * ({comp} + 1) * {p})"
    return f"CASE WHEN {s} <= 0.1111111e-36::DOUBLE THEN 0.3333333e-18::DOUBLE ELSE sqrt(greatest({s}, 0)) END"


def _cut(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-7::DOUBLE THEN 0 ELSE {x} END"


EOS = f"""WITH a AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in STATE.items())} FROM lineitem),
  b AS (SELECT *, 1 / vnew - 1 AS c1, 1 / (vnew - delv * 0.5) - 1 AS c2, en - 0.5 * delv * (p + q) AS e1 FROM a),
  c AS (SELECT *, {_press('e1', 'c2')} AS ph FROM b),
  d AS (SELECT *, CASE WHEN delv > 0 THEN 0 ELSE ({_speed('e1', 'ph', 'c2', '(1 / (1 + c2))')}) * ql + qq END AS q1 FROM c),
  f AS (SELECT *, {_cut('(e1 + 0.5 * delv * (3 * (p + q) - 4 * (ph + q1)))')} AS e2 FROM d),
  g AS (SELECT *, {_press('e2', 'c1')} AS p2 FROM f),
  h AS (SELECT *, CASE WHEN delv > 0 THEN 0 ELSE ({_speed('e2', 'p2', 'c1', 'vnew')}) * ql + qq END AS qt FROM g),
  i AS (SELECT *, {_cut('(e2 - (7 * (p + q) - 8 * (ph + q1) + (p2 + qt)) * delv / 6)')} AS e3 FROM h),
  j AS (SELECT *, {_press('e3', 'c1')} AS p3 FROM i),
  k AS (SELECT *, {_speed('e3', 'p3', 'c1', 'vnew')} AS s3 FROM j)
SELECT l_orderkey, l_linenumber, round(e3, 6) + 0.0 AS en, round(p3, 6) + 0.0 AS p, round(CASE WHEN delv > 0 THEN q1 ELSE s3 * ql + qq END, 6) + 0.0 AS q, round(s3, 6) + 0.0 AS ss, round(CASE WHEN abs(vnew - 1) < 1e-10::DOUBLE THEN 1 ELSE vnew END, 9) AS v FROM k"""


@query("H21 H24", EOS)
def eos_update(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"double({v})").alias(k) for k, v in STATE.items()])
    out = hexstep.equation_of_state(rows)
    return out.select("l_orderkey", "l_linenumber", *[(F.round(x, 6) + F.lit(0.0)).alias(x) for x in ("en", "p", "q", "ss")], F.round("v", 9).alias("v"))


@query("I09 H23 A14")
def hydro_cycles(spark, sf_dir):
    """Four cycles of the blast on a cube of 4 elements an edge, and the report at the end."""
    return hexstep.Mesh(spark, 4).run(4).report()
