"""The explicit hydrodynamics step on hexahedra, as DataFrame plans.

An element's corners stand at the signs (-1 or 1) of its three own axes. What the step needs of a
hexahedron follows from sums over corners weighted by products of signs:

* axis a of the Jacobian at the centre: an eighth of the sum of sign_a times place;
* shape derivative of a corner: the sum over axes of sign_a times the cofactor of axis a;
* the four hourglass modes: products of two signs, and of all three.

These sums over eight corners and three axes are NumPy kernels over Arrow batches of elements (`kernel`):
written as columns they are some thousand expressions an element, past the 64 KB that a generated method
may have, and Spark then interprets them (measured: 30 s a cycle of 64 elements, against 12 s on the same busy cores). Gathers,
scatters, neighbour look-ups, limiter and state update are joins, aggregates and columns.

Elements gather their corners by one join and give their forces back to the nodes by one grouped sum, with
stress and hourglass forces in the same shuffle. State tables are written each cycle (`stored`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from . import hexmesh, hydro

#: Signs of the corners along the three axes.
SIGNS = np.array([[1.0 if up else -1.0 for up in (c % 4 in (1, 2), c % 4 >= 2, c >= 4)] for c in range(8)])
MODES = np.array([SIGNS[:, list(axes)].prod(1) for axes in ((1, 2), (0, 2), (0, 1), (0, 1, 2))])
#: Faces by their corners, ordered so that normals point outwards (fixed values).
OUTWARD = ((0, 1, 2, 3), (0, 4, 5, 1), (1, 5, 6, 2), (2, 6, 7, 3), (3, 7, 4, 0), (4, 7, 6, 5))
#: The six other corners of each corner's faces, in the order that the volume's derivative takes (fixed values).
AROUND = ((1, 2, 3, 4, 5, 7), (2, 3, 0, 5, 6, 4), (3, 0, 1, 6, 7, 5), (0, 1, 2, 7, 4, 6), (7, 6, 5, 0, 3, 1), (4, 7, 6, 1, 0, 2), (5, 4, 7, 2, 1, 3), (6, 5, 4, 3, 2, 0))
#: Keeps divisions by vanishing gradients finite.
TINY = 1.0e-36
AXES = ("xi", "eta", "zeta")


#: Elements: places and velocities of the corners as (rows, 8, 3), other columns as (rows,).
Batch = dict[str, np.ndarray]


def kernel(e: DataFrame, compute: Callable[[Batch], Batch], vectors: tuple[str, ...] = (), scalars: tuple[str, ...] = ()) -> DataFrame:
    """e (columns x, y, z and where needed xd, yd, zd: eight numbers each) with what compute returns of it:
    vectors, as an array of eight (x, y, z) arrays, and scalars."""
    arrays = [x for x in ("x", "y", "z", "xd", "yd", "zd") if x in e.columns]
    numbers = [f.name for f in e.schema if isinstance(f.dataType, (T.DoubleType, T.LongType, T.IntegerType))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {x: batch.column(x).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8) for x in arrays}
            given = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in numbers}
            given["r"] = np.stack([at[x] for x in ("x", "y", "z")], -1)
            if "xd" in at:
                given["v3"] = np.stack([at[x] for x in ("xd", "yd", "zd")], -1)
            out = compute(given)
            more = [pa.array(out[v].tolist(), pa.list_(pa.list_(pa.float64()))) for v in vectors] + [pa.array(out[x], pa.float64()) for x in scalars]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *vectors, *scalars])

    schema = T.StructType([*e.schema.fields, *[T.StructField(v, T.ArrayType(T.ArrayType(T.DoubleType()))) for v in vectors], *[T.StructField(x, T.DoubleType()) for x in scalars]])
    return e.mapInArrow(run, schema)


def jacobian(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places (n, 8, 3): axes of the Jacobian and their cofactors (n, 3 axes, 3), and the volume they give."""
    j = np.einsum("ca,nci->nai", SIGNS, r) / 8
    cof = np.stack([np.cross(j[:, (a + 1) % 3], j[:, (a + 2) % 3]) for a in range(3)], 1)
    return j, cof, 8 * (j[:, 1] * cof[:, 1]).sum(1)


def shape_derivatives(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 8, 3) and the volume at the centre."""
    _, cof, det = jacobian(r)
    return np.einsum("ca,nai->nci", SIGNS, cof), det


def corner_normals(r: np.ndarray) -> np.ndarray:
    """At each corner the sum of a quarter of the area vectors of its three faces."""
    out = np.zeros_like(r)
    for face in OUTWARD:
        a, b, c, d = (r[:, k] for k in face)
        out[:, face] += (np.cross(d + c - b - a, c + b - d - a) / 16)[:, None]
    return out


def volume_derivatives(r: np.ndarray) -> np.ndarray:
    """How the volume changes with the place of each corner."""
    out = np.empty_like(r)
    for k, around in enumerate(AROUND):
        a, b, c, d, e, f = (r[:, i] for i in around)
        out[:, k] = (np.cross(b + c, a + b) + np.cross(a + e, d + e) - np.cross(c + f, d + f)) / 12
    return out


def stress_forces(b: Batch) -> np.ndarray:
    """Force of the stress -p - q on each corner."""
    return (b["p"] + b["q"])[:, None, None] * corner_normals(b["r"])


def hourglass_forces(b: Batch, hgcoef: float = hydro.C.hgcoef) -> np.ndarray:
    """Force on each corner that damps the four hourglass modes (volo, v, ss, mass; velocities)."""
    determ = b["volo"] * b["v"]
    moments = np.einsum("mc,nci->nmi", MODES, b["r"])
    gam = MODES[None] - np.einsum("nci,nmi->nmc", volume_derivatives(b["r"]), moments) / determ[:, None, None]
    swing = np.einsum("nmc,nci->nmi", gam, b["v3"])
    damp = -0.01 * hgcoef * b["ss"] * b["mass"] / np.cbrt(determ)
    return damp[:, None, None] * np.einsum("nmc,nmi->nci", gam, swing)


def forces(e: DataFrame) -> DataFrame:
    """e with f: stress and hourglass forces on the corners. Elements of no volume: `collapsed`."""
    return kernel(e, lambda b: {"f": stress_forces(b) + hourglass_forces(b)}, ("f",))


def collapsed(e: DataFrame, volume: str = "v") -> DataFrame:
    """Elements whose volume is not positive."""
    return e.where(F.col(volume) <= 0)


def node_forces(e: DataFrame, corner_table: DataFrame, force: str = "f") -> DataFrame:
    """(n, fx, fy, fz): the corners' forces summed at their nodes."""
    flat = e.select("e", F.posexplode(force).alias("c", "f"))
    at = flat.join(corner_table.select("e", F.col("c").cast("int").alias("c"), "n"), ["e", "c"])
    return at.groupBy("n").agg(*[F.sum(F.col("f")[i]).alias(f"f{x}") for i, x in enumerate("xyz")])


def moved(nodes: DataFrame, forces: DataFrame, dt: float, k: hydro.Constants = hydro.C) -> DataFrame:
    """nodes (n, ix, iy, iz, x, y, z, xd, yd, zd, mass) after dt: accelerations vanish across the symmetry
    planes, small velocities are cut off, and places follow the new velocities."""
    out = nodes.join(forces, "n")
    for x in "xyz":
        a = F.when(F.col(f"i{x}") == 0, 0.0).otherwise(F.col(f"f{x}") / F.col("mass"))
        v = F.col(f"{x}d") + a * dt
        out = out.withColumn(f"{x}d", F.when(F.abs(v) < k.u_cut, 0.0).otherwise(v))
    return out.withColumns({x: F.col(x) + F.col(f"{x}d") * dt for x in "xyz"}).drop("fx", "fy", "fz")


def _kinematics(b: Batch, dt: float) -> Batch:
    """Velocity gradient's diagonal half a step back, and extents and velocity differences along the axes."""
    r, v = b["r"], b["v3"]
    shape, det = shape_derivatives(r - 0.5 * dt * v)
    d = np.einsum("nci,nci->ni", shape, v) / det[:, None]
    vol = b["volo"] * b["vnew"]
    span, speed = (np.einsum("ca,nci->nai", SIGNS, x) / 4 for x in (r, v))
    out = {name: d[:, i] for i, name in enumerate(("dxx", "dyy", "dzz"))}
    for a, name in enumerate(AXES):
        area = np.cross(span[:, (a + 1) % 3], span[:, (a + 2) % 3])
        out[f"delx_{name}"] = vol / np.sqrt((area * area).sum(1) + TINY)
        out[f"delv_{name}"] = (area * speed[:, a]).sum(1) / (vol + TINY)
    return out


def kinematics(e: DataFrame, dt: float) -> DataFrame:
    """e (gathered new places and velocities, volo, v) with vnew, delv, arealg, dxx, dyy, dzz and their sum
    vdov, delx_<axis> and delv_<axis>."""
    e = e.withColumn("volume", hexmesh.volume())
    e = e.withColumns({"vnew": F.col("volume") / F.col("volo"), "arealg": hexmesh.characteristic_length(F.col("volume"))})
    e = e.withColumn("delv", F.col("vnew") - F.col("v")).drop("volume")
    e = kernel(e, lambda b: _kinematics(b, dt), scalars=("dxx", "dyy", "dzz", *[f"{k}_{a}" for a in AXES for k in ("delx", "delv")]))
    return e.withColumn("vdov", hydro.deviators(F.col("dxx"), F.col("dyy"), F.col("dzz"))[0])


def limited(e: DataFrame, neighbours: DataFrame, boundary: DataFrame, k: hydro.Constants = hydro.C) -> DataFrame:
    """e (delv_*, delx_*, vdov, mass, volo, vnew) with ql and qq: viscosity terms whose slopes are limited by
    the six neighbours. Across a symmetry plane (bit 0 of an axis's flags) the element is its own
    neighbour, beyond a free face (bit 2) the gradient is 0. `neighbours` and `boundary` are those
    of the mesh. The six look-ups are one join: neighbours turned to rows, summed back by element."""
    sides = ((0, "lxim", "lxip"), (1, "letam", "letap"), (2, "lzetam", "lzetap"))
    wanted = neighbours.select("e", F.explode(F.array(*[F.struct(F.lit(f"{AXES[a]}{s}").alias("side"), F.lit(a).alias("axis"), F.col(n).alias("near")) for a, *names in sides for s, n in zip("mp", names)])).alias("w")).select("e", "w.*")
    given = e.select(F.col("e").alias("near"), F.array(*[F.col(f"delv_{x}") for x in AXES]).alias("delv"))
    beside = wanted.join(given, "near").groupBy("e").agg(*[F.max(F.when(F.col("side") == f"{x}{s}", F.col("delv")[a])).alias(f"near_{x}{s}") for a, x in enumerate(AXES) for s in "mp"])
    out = e.join(beside, "e").join(boundary.select("e", "bc"), "e")
    for a, x in enumerate(AXES):
        own, flags = F.col(f"delv_{x}"), F.shiftright("bc", 3 * a).bitwiseAND(F.lit(7))

        def side(s: str) -> Column:
            bit = {"m": 1, "p": 4}[s]
            low = F.when(flags.bitwiseAND(F.lit(bit)) == 0, F.col(f"near_{x}{s}"))  # noqa: B023
            return low.otherwise(own if s == "m" else 0.0) / (own + TINY)  # noqa: B023

        down, up = side("m"), side("p")
        slope = F.least(0.5 * (down + up), k.monoq_limiter_mult * down, k.monoq_limiter_mult * up)
        out = out.withColumn(f"phi_{x}", F.least(F.greatest(slope, F.lit(0.0)), F.lit(k.monoq_max_slope)))
        out = out.withColumn(f"in_{x}", F.least(own * F.col(f"delx_{x}"), F.lit(0.0)))
    rho = F.col("mass") / (F.col("volo") * F.col("vnew"))
    linear = sum((F.col(f"in_{x}") * (1 - F.col(f"phi_{x}")) for x in AXES[1:]), F.col("in_xi") * (1 - F.col("phi_xi")))
    square = [F.col(f"in_{x}") * F.col(f"in_{x}") * (1 - F.col(f"phi_{x}") * F.col(f"phi_{x}")) for x in AXES]
    spread = F.col("vdov") > 0
    out = out.withColumns({"ql": F.when(spread, 0.0).otherwise(-k.qlc_monoq * rho * linear), "qq": F.when(spread, 0.0).otherwise(k.qqc_monoq * rho * (square[0] + square[1] + square[2]))})
    return out.drop("bc", *[f"{p}_{x}{s}" for p in ("near",) for x in AXES for s in "mp"], *[f"{p}_{x}" for p in ("phi", "in") for x in AXES])


#: Slope of pressure over energy and compression; least squared sound speed and its root (fixed values).
GAMMA, LEAST_SS2, LEAST_SS = 2.0 / 3.0, 0.1111111e-36, 0.3333333e-18


def equation_of_state(e: DataFrame, k: hydro.Constants = hydro.C) -> DataFrame:
    """e (en, p, q, v, vnew, delv, ql, qq) with en, p, q, v and ss at the end of the step: energy is predicted
    with the old pressure, corrected with that of the half step, and corrected again at the end."""
    cut = lambda x, least: F.when(F.abs(x) < least, 0.0).otherwise(x)
    floor = lambda x: F.greatest(x, F.lit(k.emin))
    out = e.withColumn("vn", F.greatest(F.least(F.col("vnew"), F.lit(k.eosvmax)), F.lit(k.eosvmin)))
    thin, grows = F.col("vn") >= k.eosvmax, F.col("delv") > 0
    comp = 1 / F.col("vn") - 1
    half = F.when(thin, 0.0).when(F.col("vn") <= k.eosvmin, comp).otherwise(1 / (F.col("vn") - F.col("delv") * 0.5) - 1)
    out = out.withColumns({"p0": F.when(thin, 0.0).otherwise(F.col("p")), "comp": F.when(thin, 0.0).otherwise(comp), "half": half})

    def pressure(energy: Column, compression: str) -> Column:
        p = cut(GAMMA * (F.col(compression) + 1) * energy, k.p_cut)
        return F.greatest(F.when(thin, 0.0).otherwise(p), F.lit(k.pmin))

    def sound(energy: Column, p: Column, compression: str, vol: Column) -> Column:
        s = (GAMMA * energy + vol * vol * GAMMA * (F.col(compression) + 1) * p) / k.refdens
        return F.when(s <= LEAST_SS2, LEAST_SS).otherwise(F.sqrt(s))

    def viscous(speed: Column) -> Column:
        return F.when(grows, 0.0).otherwise(speed * F.col("ql") + F.col("qq"))

    d = F.col("delv")
    out = out.withColumn("e1", floor(F.col("en") - 0.5 * d * (F.col("p0") + F.col("q"))))
    out = out.withColumn("ph", pressure(F.col("e1"), "half"))
    out = out.withColumn("q1", viscous(sound(F.col("e1"), F.col("ph"), "half", 1 / (1 + F.col("half")))))
    out = out.withColumn("e2", floor(cut(F.col("e1") + 0.5 * d * (3.0 * (F.col("p0") + F.col("q")) - 4.0 * (F.col("ph") + F.col("q1"))), k.e_cut)))
    out = out.withColumn("p2", pressure(F.col("e2"), "comp"))
    out = out.withColumn("qt", viscous(sound(F.col("e2"), F.col("p2"), "comp", F.col("vn"))))
    last = F.col("e2") - (7.0 * (F.col("p0") + F.col("q")) - 8.0 * (F.col("ph") + F.col("q1")) + (F.col("p2") + F.col("qt"))) * d / 6.0
    out = out.withColumn("e3", floor(cut(last, k.e_cut)))
    out = out.withColumn("p3", pressure(F.col("e3"), "comp"))
    out = out.withColumn("ss", sound(F.col("e3"), F.col("p3"), "comp", F.col("vn")))
    q = F.when(grows, F.col("q1")).otherwise(cut(F.col("ss") * F.col("ql") + F.col("qq"), k.q_cut))
    out = out.withColumns({"q": q, "en": F.col("e3"), "p": F.col("p3"), "v": F.when(F.abs(F.col("vn") - 1) < k.v_cut, 1.0).otherwise(F.col("vn"))})
    return out.drop("vn", "p0", "comp", "half", "e1", "ph", "q1", "e2", "p2", "qt", "e3", "p3")


ELEMENT = ("e", "region", "en", "p", "q", "v", "ss", "volo", "mass")


class Mesh:
    """A cube of `side` elements an edge, energy in the element at the origin; tables of state after each step."""

    def __init__(self, spark, side: int, regions: int = 11):
        from . import generators

        self.side = side
        self.corners = stored(generators.hex_corners(spark, side), "hydro-corners")
        self.neighbours, self.boundary = generators.hex_neighbours(spark, side), generators.hex_boundary(spark, side)
        places = generators.hex_nodes(spark, side)
        e = hexmesh.gather(self.corners, places).withColumn("volume", hexmesh.volume())
        at_origin = 3.948746e7 * (side / 45.0) ** 3
        zero = F.lit(0.0)
        self.elements = stored(
            e.select("e", (F.col("e") % regions).cast("int").alias("region"), F.when(F.col("e") == 0, at_origin).otherwise(0.0).alias("en"), zero.alias("p"), zero.alias("q"), F.lit(1.0).alias("v"), zero.alias("ss"), F.col("volume").alias("volo"), F.col("volume").alias("mass")),
            "hydro-elements",
        )
        mass = hexmesh.nodal_mass(self.corners, self.elements.withColumnRenamed("volo", "volume"))
        self.nodes = stored(places.join(mass, "n").select("n", "ix", "iy", "iz", "x", "y", "z", zero.alias("xd"), zero.alias("yd"), zero.alias("zd"), "mass"), "hydro-nodes")
        volume = (1.125 / side) ** 3
        self.clock = hydro.Clock(dt=0.5 * volume ** (1 / 3) / (2.0 * at_origin) ** 0.5)

    def _gathered(self, elements: DataFrame) -> DataFrame:
        return hexmesh.gather(self.corners, self.nodes, ("x", "y", "z", "xd", "yd", "zd")).join(elements, "e")

    def step(self) -> None:
        """One cycle: forces, motion, new volumes, viscosity, state, and the limits of the next step."""
        self.clock = hydro.advance(self.clock)
        dt = self.clock.dt
        push = node_forces(forces(self._gathered(self.elements)), self.corners)
        self.nodes = stored(moved(self.nodes, push, dt), "hydro-nodes")
        new = kinematics(self._gathered(self.elements), dt).drop("x", "y", "z", "xd", "yd", "zd")
        new = equation_of_state(limited(stored(new, "hydro-kinematics"), self.neighbours, self.boundary))
        self.elements = stored(new.select(*ELEMENT, "vdov", "arealg"), "hydro-elements")
        limits = hydro.region_limits(self.elements.withColumnRenamed("arealg", "length")).agg(F.min("courant"), F.min("hydro")).first()
        self.clock = replace(self.clock, courant=limits[0], hydro=limits[1])

    def run(self, cycles: int) -> "Mesh":
        for _ in range(cycles):
            self.step()
        return self

    def report(self) -> DataFrame:
        """cycle, time, elements, origin_energy, and how far the energies of plane 0 are from symmetry:
        max_diff, total_diff and max_relative."""
        s = self.side
        plane = self.elements.where(F.col("e") < s * s).select((F.col("e") % s).alias("j"), F.floor(F.col("e") / s).alias("k"), "en")
        other = plane.select(F.col("k").alias("j"), F.col("j").alias("k"), F.col("en").alias("other"))
        d = F.abs(F.col("en") - F.col("other"))
        gaps = plane.join(other, ["j", "k"]).where("j < k").agg(F.max(d).alias("max_diff"), F.sum(d).alias("total_diff"), F.max(F.when(F.col("other") != 0, d / F.abs("other"))).alias("max_relative"))
        at = self.elements.agg(F.count(F.lit(1)).alias("elements"), F.max(F.when(F.col("e") == 0, F.col("en"))).alias("origin_energy"))
        return at.crossJoin(gaps).select(F.lit(self.clock.cycle).cast("long").alias("cycle"), F.lit(self.clock.time).alias("time"), "*")  # one row each
