"""The hydrodynamics clock, limits and motion on small inputs."""

from dataclasses import replace

import pytest

from gridloom.operators import hydro


def test_first_step_keeps_its_dt_and_later_ones_grow_within_bounds():
    c = hydro.advance(hydro.Clock(dt=1e-4, courant=1.0, hydro=1.0))
    assert (c.cycle, c.dt, c.time) == (1, 1e-4, 1e-4)
    c = hydro.advance(c)
    assert c.dt == pytest.approx(1.2e-4)
    still = hydro.advance(replace(c, courant=2 * 1.05 * c.dt))
    assert still.dt == c.dt
    # the smaller limit counts with two thirds
    assert hydro.advance(replace(c, courant=2e-4, hydro=3e-5)).dt == pytest.approx(2e-5)
    # of a volume limit that is not below half the sound limit nothing is taken
    assert hydro.advance(replace(c, courant=1e-4, hydro=9e-5)).dt == pytest.approx(5e-5)


def test_clock_ends_at_the_stop_time_without_a_sliver():
    c, dts = hydro.Clock(dt=3e-3, courant=1.0, hydro=1.0), []
    while c.time < hydro.C.stoptime:
        c = hydro.advance(c)
        dts.append(c.dt)
        assert len(dts) < 50
    assert c.time == pytest.approx(hydro.C.stoptime)
    assert min(dts) > 1e-3


def test_region_limits_ties_rest_and_empty(spark):
    schema = "e long, region int, ss double, vdov double, length double"
    rows = [(5, 1, 2.0, 0.5, 1.0), (3, 1, 2.0, 0.5, 1.0), (7, 2, 1.0, 0.0, 1.0), (9, 3, 0.0, -1.0, 1.0)]
    got = {r["region"]: r for r in hydro.region_limits(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["courant"], got[1]["courant_e"], got[1]["hydro_e"]) == (0.5, 3, 3)
    assert (got[2]["courant"], got[2]["courant_e"], got[2]["hydro"]) == (hydro.UNBOUND, None, hydro.UNBOUND)
    assert got[3]["courant"] == pytest.approx(1 / 16) and got[3]["hydro"] == pytest.approx(0.1)
    assert hydro.region_limits(spark.createDataFrame([], schema)).count() == 0


def test_motion_stops_at_planes_and_cuts_tiny_speeds(spark):
    schema = ", ".join(f"{c} double" for c in "n x y z xd yd zd fx fy fz mass".split())
    nodes = spark.createDataFrame([(1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 4.0, 4.0, 1e-9, 2.0)], schema)
    r = hydro.move(hydro.accelerate(nodes), 0.5).first()
    assert (r["xdd"], r["xd"], r["x"]) == (0.0, 0.0, 0.0)
    assert (r["ydd"], r["yd"], r["y"]) == (2.0, 1.0, 1.5)
    assert (r["zd"], r["z"]) == (0.0, 1.0)


def test_time_increment_reaches_the_stop_time(spark):
    from gridloom.plans import catalog

    rows = catalog.queries()["time_increment"](spark, "/root/testdata/sf0.001").orderBy("cycle").collect()
    assert rows[-1]["time"] == pytest.approx(hydro.C.stoptime) and rows[0]["dt"] == pytest.approx(1e-4)
