"""Scalar and per-element parts of the explicit hydrodynamics step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constants:
    """Fixed values of the model."""

    e_cut: float = 1.0e-7
    p_cut: float = 1.0e-7
    q_cut: float = 1.0e-7
    v_cut: float = 1.0e-10
    u_cut: float = 1.0e-7
    hgcoef: float = 3.0
    ss4o3: float = 4.0 / 3.0
    qstop: float = 1.0e12
    monoq_max_slope: float = 1.0
    monoq_limiter_mult: float = 2.0
    qlc_monoq: float = 0.5
    qqc_monoq: float = 2.0 / 3.0
    qqc: float = 2.0
    eosvmax: float = 1.0e9
    eosvmin: float = 1.0e-9
    pmin: float = 0.0
    emin: float = -1.0e15
    dvovmax: float = 0.1
    refdens: float = 1.0
    stoptime: float = 1.0e-2
    growth_low: float = 1.1
    growth_high: float = 1.2
    dtmax: float = 1.0e-2


C = Constants()
#: A time step that binds nothing.
UNBOUND = 1.0e20


@dataclass(frozen=True)
class Clock:
    time: float = 0.0
    dt: float = 0.0
    cycle: int = 0
    courant: float = UNBOUND
    hydro: float = UNBOUND


def advance(c: Clock, k: Constants = C) -> Clock:
    """The clock after one more step. The first step keeps its dt; later ones take half the sound
    limit, or two thirds of the volume limit where that one is smaller, growing within bounds; a
    last step that would leave a sliver is split."""
    dt = c.dt
    if c.cycle:
        new = UNBOUND
        if c.courant < new:
            new = c.courant / 2.0
        if c.hydro < new:
            new = c.hydro * 2.0 / 3.0
        grown = new / dt
        if 1.0 <= grown < k.growth_low:
            new = dt
        elif grown > k.growth_high:
            new = dt * k.growth_high
        dt = min(new, k.dtmax)
    left = k.stoptime - c.time
    if dt < left < 4.0 * dt / 3.0:
        left = 2.0 * dt / 3.0
    dt = min(dt, left)
    return Clock(c.time + dt, dt, c.cycle + 1, c.courant, c.hydro)


def stress(p: Column, q: Column) -> Column:
    """The isotropic stress, the same on all three axes."""
    return -p - q


def sound_limit(ss: Column, vdov: Column, length: Column, k: Constants = C) -> Column:
    """Time that a signal needs to cross an element; null where its volume does not change."""
    squeeze = F.when(vdov < 0, 64.0 * k.qqc * k.qqc * length * length * vdov * vdov).otherwise(0.0)
    return F.when(vdov != 0, length / F.sqrt(ss * ss + squeeze))


def volume_limit(vdov: Column, k: Constants = C) -> Column:
    """Time in which an element's volume changes by the largest share allowed."""
    return F.when(vdov != 0, k.dvovmax / (F.abs(vdov) + 1.0e-20))


def region_limits(elements: DataFrame, k: Constants = C) -> DataFrame:
    """Of elements (e, region, ss, vdov, length): per region the two limits and the first element
    that sets each. Regions at rest have UNBOUND and null. One partial aggregate, one row a region."""
    v = F.col("vdov")
    t = elements.withColumn("a", sound_limit(F.col("ss"), v, F.col("length"), k)).withColumn("b", volume_limit(v, k))
    least = lambda c: F.min(F.when(F.col(c) < UNBOUND, F.struct(c, "e")))
    g = t.groupBy("region").agg(least("a").alias("a"), least("b").alias("b"))
    return g.select("region", F.coalesce("a.a", F.lit(UNBOUND)).alias("courant"), F.col("a.e").alias("courant_e"), F.coalesce("b.b", F.lit(UNBOUND)).alias("hydro"), F.col("b.e").alias("hydro_e"))


def accelerate(nodes: DataFrame) -> DataFrame:
    """nodes (n, x, y, z, fx, fy, fz, mass) with (xdd, ydd, zdd): force by mass, none across the
    symmetry planes x = 0, y = 0 and z = 0."""
    return nodes.withColumns({f"{c}dd": F.when(F.col(c) == 0, 0.0).otherwise(F.col(f"f{c}") / F.col("mass")) for c in "xyz"})


def move(nodes: DataFrame, dt: float, k: Constants = C) -> DataFrame:
    """Velocities, cut off to 0 where tiny, and then positions after a step of dt."""
    speed = {}
    for c in "xyz":
        v = F.col(f"{c}d") + F.col(f"{c}dd") * dt
        speed[f"{c}d"] = F.when(F.abs(v) < k.u_cut, 0.0).otherwise(v)
    moved = nodes.withColumns(speed)
    return moved.withColumns({c: F.col(c) + F.col(f"{c}d") * dt for c in "xyz"})


def deviators(dxx: Column, dyy: Column, dzz: Column) -> tuple[Column, Column, Column, Column]:
    """Relative volume change by time and what the three principal strains are besides a third of it."""
    vdov = dxx + dyy + dzz
    return vdov, dxx - vdov / 3.0, dyy - vdov / 3.0, dzz - vdov / 3.0


def beyond_stop(elements: DataFrame, k: Constants = C) -> DataFrame:
    """Elements whose artificial viscosity is beyond the stop value."""
    return elements.where(F.col("q") > k.qstop)
