"""The hydrodynamics step on a bent mesh, against a version of loops and finite differences."""

from dataclasses import replace

import numpy as np
import pytest

from gridloom.operators import generators, hexmesh, hexstep, hydro

GEO = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]


def bent(n, seed):
    rng = np.random.default_rng(seed)
    return np.array(GEO, float)[None] * rng.uniform(0.3, 0.7, (n, 1, 3)) + rng.uniform(-0.1, 0.1, (n, 8, 3)) + rng.uniform(-3, 3, (n, 1, 3))


def volume(r):
    """Sum over faces of the flux of place through each bent face, by quadrature."""
    g = 1 / np.sqrt(3)
    total = 0.0
    for face in hexstep.OUTWARD:
        p = r[list(face)]
        for s in (-g, g):
            for t in (-g, g):
                w = np.array([(1 - s) * (1 - t), (1 + s) * (1 - t), (1 + s) * (1 + t), (1 - s) * (1 + t)]) / 4
                ds = np.array([-(1 - t), 1 - t, 1 + t, -(1 + t)]) / 4
                dt = np.array([-(1 - s), -(1 + s), 1 + s, 1 - s]) / 4
                # faces are listed with normals inwards by the right hand: the sign is the outward one
                total -= np.dot(w @ p, np.cross(ds @ p, dt @ p)) / 3
    return abs(total)


def test_volume_derivatives_are_those_of_the_volume():
    for r in bent(6, 1):
        got = hexstep.volume_derivatives(r[None])[0]
        for c in range(8):
            for i in range(3):
                up, down = r.copy(), r.copy()
                up[c, i] += 1e-5
                down[c, i] -= 1e-5
                assert abs((volume(up) - volume(down)) / 2e-5 - got[c, i]) < 1e-7


def test_shape_derivatives_differentiate_linear_fields():
    r = bent(20, 2)
    shape, det = hexstep.shape_derivatives(r)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3, 3))
    field = r @ a.T
    slope = np.einsum("nci,ncj->nij", field, shape) / det[:, None, None]
    assert np.allclose(slope, a) and np.allclose(shape.sum(1), 0)
    assert np.allclose(hexstep.corner_normals(r).sum(1), 0)  # faces close


def test_hourglass_forces_spare_linear_motion():
    r = bent(20, 4)
    rng = np.random.default_rng(5)
    vol = np.array([volume(x) for x in r])
    b = {"r": r, "v3": r @ rng.normal(size=(3, 3)).T + 1.5, "volo": vol, "v": np.ones(20), "ss": np.full(20, 2.0), "mass": vol}
    # modes are taken out by the volume's derivative, which is exact for motion that is linear over the element
    assert np.abs(hexstep.hourglass_forces(b)).max() < 1e-10
    b["v3"] = rng.normal(size=r.shape)
    f = hexstep.hourglass_forces(b)
    assert (np.einsum("nci,nci->n", f, b["v3"]) < 0).all()  # it takes energy out


def state_update(en, p, q, v, vnew, delv, ql, qq, k=hydro.C):
    """One element's state, statement by statement."""
    v1 = min(max(vnew, k.eosvmin), k.eosvmax)
    comp, half = 1 / v1 - 1, 1 / (v1 - delv / 2) - 1
    if v1 <= k.eosvmin:
        half = comp
    if v1 >= k.eosvmax:
        p, comp, half = 0.0, 0.0, 0.0

    def pressure(e, c):
        out = hexstep.GAMMA * (c + 1) * e
        if abs(out) < k.p_cut or v1 >= k.eosvmax:
            out = 0.0
        return max(out, k.pmin)

    def speed(e, pr, c, vol):
        s = hexstep.GAMMA * e + vol * vol * hexstep.GAMMA * (c + 1) * pr
        return hexstep.LEAST_SS if s <= hexstep.LEAST_SS2 else s**0.5

    clean = lambda e: max(0.0 if abs(e) < k.e_cut else e, k.emin)
    e = max(en - 0.5 * delv * (p + q), k.emin)
    ph = pressure(e, half)
    q1 = 0.0 if delv > 0 else speed(e, ph, half, 1 / (1 + half)) * ql + qq
    e = clean(e + 0.5 * delv * (3 * (p + q) - 4 * (ph + q1)))
    p2 = pressure(e, comp)
    qt = 0.0 if delv > 0 else speed(e, p2, comp, v1) * ql + qq
    e = clean(e - (7 * (p + q) - 8 * (ph + q1) + p2 + qt) * delv / 6)
    p3 = pressure(e, comp)
    ss = speed(e, p3, comp, v1)
    if delv <= 0:
        q1 = ss * ql + qq
        q1 = 0.0 if abs(q1) < k.q_cut else q1
    return e, p3, q1, 1.0 if abs(v1 - 1) < k.v_cut else v1, ss


def cycles(side, n):
    """The whole loop over NumPy arrays and Python loops, apart from the DataFrame plans."""
    w, h = side + 1, 1.125 / side
    node = {(i, j, k): i + w * (j + w * k) for k in range(w) for j in range(w) for i in range(w)}
    pos = np.array([(i * h, j * h, k * h) for (i, j, k) in node])
    fixed = pos == 0
    cells = [(i, j, k) for k in range(side) for j in range(side) for i in range(side)]
    corner = np.array([[node[i + (g[0] + 1) // 2, j + (g[1] + 1) // 2, k + (g[2] + 1) // 2] for g in GEO] for i, j, k in cells])
    m = len(cells)
    vol0 = np.full(m, h**3)
    en, p, q, v, ss = np.zeros(m), np.zeros(m), np.zeros(m), np.ones(m), np.zeros(m)
    en[0] = 3.948746e7 * (side / 45) ** 3
    mass = np.bincount(corner.ravel(), np.repeat(vol0 / 8, 8), len(pos))
    vel = np.zeros_like(pos)
    clock = hydro.Clock(dt=0.5 * h / (2 * en[0]) ** 0.5)
    for _ in range(n):
        clock = hydro.advance(clock)
        dt = clock.dt
        force = np.zeros_like(pos)
        for e in range(m):
            r, u = pos[corner[e]], vel[corner[e]]
            for face in hexstep.OUTWARD:
                a, b, c, d = r[list(face)]
                area = np.cross((d + c - b - a) / 2, (c + b - d - a) / 2) / 4
                force[corner[e][list(face)]] += (p[e] + q[e]) * area
            dv = hexstep.volume_derivatives(r[None])[0]
            det = vol0[e] * v[e]
            for mode in hexstep.MODES:
                hm = sum(mode[c] * r[c] for c in range(8))
                gam = [mode[c] - np.dot(dv[c], hm) / det for c in range(8)]
                swing = sum(gam[c] * u[c] for c in range(8))
                for c in range(8):
                    force[corner[e][c]] += -0.01 * 3.0 * ss[e] * vol0[e] / det ** (1 / 3) * gam[c] * swing
        acc = np.where(fixed, 0, force / mass[:, None])
        vel = vel + acc * dt
        vel[np.abs(vel) < hydro.C.u_cut] = 0
        pos = pos + vel * dt
        vnew = np.array([volume(pos[c]) for c in corner]) / vol0
        delv = vnew - v
        length, vdov, delx, dv3 = np.zeros(m), np.zeros(m), np.zeros((m, 3)), np.zeros((m, 3))
        s = np.array(GEO, float)
        for e in range(m):
            r, u = pos[corner[e]], vel[corner[e]]
            areas = []
            for face in hexstep.OUTWARD:
                a, b, c, d = r[list(face)]
                f, g = (c - a) - (d - b), (c - a) + (d - b)
                areas.append(f @ f * (g @ g) - (f @ g) ** 2)
            length[e] = 4 * vnew[e] * vol0[e] / max(areas) ** 0.5
            shape, det = hexstep.shape_derivatives((r - dt / 2 * u)[None])
            vdov[e] = (shape[0] * u).sum() / det[0]
            span, speed = s.T @ r / 4, s.T @ u / 4
            for a in range(3):
                area = np.cross(span[(a + 1) % 3], span[(a + 2) % 3])
                delx[e, a] = vnew[e] * vol0[e] / (area @ area + 1e-36) ** 0.5
                dv3[e, a] = area @ speed[a] / (vnew[e] * vol0[e] + 1e-36)
        out = []
        for e, cell in enumerate(cells):
            lin = quad = 0.0
            for a in range(3):
                step = side**a
                own = dv3[e, a]
                low = (own if cell[a] == 0 else dv3[e - step, a]) / (own + 1e-36)
                high = (0.0 if cell[a] == side - 1 else dv3[e + step, a]) / (own + 1e-36)
                phi = min(max(min((low + high) / 2, 2 * low, 2 * high), 0), 1)
                inward = min(own * delx[e, a], 0)
                lin += inward * (1 - phi)
                quad += inward**2 * (1 - phi**2)
            rho = 1 / vnew[e]
            ql, qq = (0.0, 0.0) if vdov[e] > 0 else (-0.5 * rho * lin, 2 / 3 * rho * quad)
            out.append(state_update(en[e], p[e], q[e], v[e], vnew[e], delv[e], ql, qq))
        en, p, q, v, ss = map(np.array, zip(*out))
        squeeze = np.where(vdov < 0, 256.0 * length**2 * vdov**2, 0)
        moving = vdov != 0
        clock = replace(clock, courant=(length / np.sqrt(ss**2 + squeeze))[moving].min(initial=hydro.UNBOUND), hydro=(0.1 / (np.abs(vdov) + 1e-20))[moving].min(initial=hydro.UNBOUND))
    return clock, en, p, q, v, pos


@pytest.mark.parametrize("side, n", [(3, 4)])
def test_cycles_equal_the_loops(spark, side, n):
    mesh = hexstep.Mesh(spark, side).run(n)
    clock, en, p, q, v, pos = cycles(side, n)
    got = mesh.elements.orderBy("e").toPandas()
    assert np.allclose(got["en"], en, rtol=1e-9, atol=1e-6) and np.allclose(got["p"], p, rtol=1e-9, atol=1e-6)
    assert np.allclose(got["q"], q, rtol=1e-9, atol=1e-6) and np.allclose(got["v"], v, rtol=1e-10)
    nodes = mesh.nodes.orderBy("n").toPandas()
    assert np.allclose(nodes[["x", "y", "z"]].to_numpy(), pos, atol=1e-12)
    assert abs(mesh.clock.time - clock.time) < 1e-15 and mesh.clock.cycle == n
    report = mesh.report().first()
    assert report.cycle == n and report.elements == side**3 and report.max_diff < 1e-8 and abs(report.origin_energy - en[0]) < 1e-6


def test_nothing_collapses_on_the_regular_mesh(spark):
    e = hexmesh.gather(generators.hex_corners(spark, 2), generators.hex_nodes(spark, 2)).withColumn("v", hexmesh.volume())
    assert hexstep.collapsed(e).count() == 0
