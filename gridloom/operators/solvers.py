"""Iterative solvers: the recurrences run on the driver, every vector stays a column of one table.

State tables are written to the shared folder once an iteration (lineage ends there), and all inner
products that one step needs share one aggregate. The matrix is stored by column once, so that a
product reads it as it lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .vectors import diagonal, dots, spmv


@dataclass(frozen=True)
class Solved:
    x: DataFrame  # (i, x)
    residual: float  # as the recurrence has it
    iterations: int


def _times(a: DataFrame, state: DataFrame, value: str, out: str) -> DataFrame:
    """state with out = A value."""
    return state.join(spmv(a, state, value, out), "i", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def _c(name: str) -> Column:
    return F.col(name)


def _start(a: DataFrame, b: DataFrame, **columns: Column) -> DataFrame:
    d = diagonal(a, b).withColumn("m", F.coalesce(F.try_divide(F.lit(1.0), F.col("d")), F.lit(0.0)))
    s = b.select("i", F.col("b").cast("double").alias("b")).join(d.select("i", "m"), "i").withColumn("x", F.lit(0.0))
    return stored(s.withColumns(columns) if columns else s, "state")


def cg(a: DataFrame, b: DataFrame, iterations: int = 50, preconditioned: bool = True, tolerance: float = 0.0) -> Solved:
    """Conjugate gradients with Jacobi preconditioning. Stops early at an exact solution."""
    z = _c("m") * _c("r") if preconditioned else _c("r")
    s = _start(a, b, r=_c("b")).withColumn("z", z).withColumn("p", _c("z"))
    gamma, k = dots(s, g=(_c("r"), _c("z")))["g"], 0
    while k < iterations and gamma > 0 and math.sqrt(gamma) > tolerance:
        s = stored(_times(a, s, "p", "q"), "state")
        alpha = gamma / dots(s, pq=(_c("p"), _c("q")))["pq"]
        s = s.withColumns({"x": _c("x") + alpha * _c("p"), "r": _c("r") - alpha * _c("q")}).withColumn("z", z)
        new = dots(s, g=(_c("r"), _c("z")))["g"]
        s = s.withColumn("p", _c("z") + (new / gamma) * _c("p")).drop("q")
        gamma, k = new, k + 1
    return Solved(s.select("i", "x"), math.sqrt(max(gamma, 0.0)), k)


def hpc_cg(a: DataFrame, b: DataFrame, max_iterations: int = 50, tolerance: float = 0.0) -> Solved:
    """Conjugate gradients without preconditioner; the loop counts from 1, so it makes one step
    fewer than max_iterations."""
    return cg(a, b, max_iterations - 1, preconditioned=False, tolerance=tolerance)


def cr(a: DataFrame, b: DataFrame, iterations: int = 50) -> Solved:
    """Conjugate residuals on the Jacobi-preconditioned system; one product an iteration."""
    s = _start(a, b).withColumn("r", _c("m") * _c("b")).withColumn("p", _c("r"))
    s = _times(a, s, "r", "ar").withColumn("ap", _c("ar"))
    s = stored(s, "state")
    rho, k = dots(s, rho=(_c("r"), _c("ar")))["rho"], 0
    while k < iterations and rho:
        down = dots(s, d=(_c("ap"), _c("m") * _c("ap")))["d"]
        if not down:
            break
        alpha = rho / down
        s = s.withColumns({"x": _c("x") + alpha * _c("p"), "r": _c("r") - alpha * _c("m") * _c("ap")})
        s = stored(_times(a, s.drop("ar"), "r", "ar"), "state")
        new = dots(s, rho=(_c("r"), _c("ar")))["rho"]
        s = s.withColumns({"p": _c("r") + (new / rho) * _c("p"), "ap": _c("ar") + (new / rho) * _c("ap")})
        rho, k = new, k + 1
    return Solved(s.select("i", "x"), math.sqrt(abs(rho)), k)


def minres(a: DataFrame, b: DataFrame, iterations: int = 50, floor: float = 1e-300) -> Solved:
    """MINRES for symmetric, possibly indefinite systems: Lanczos with Givens rotations."""
    s = _start(a, b).withColumns({"r1": _c("b"), "r2": _c("b"), "y": F.abs("m") * _c("b"), "w": F.lit(0.0), "w2": F.lit(0.0)})
    s = stored(s, "state")
    beta = math.sqrt(max(dots(s, d=(_c("r1"), _c("y")))["d"], 0.0))
    oldb, dbar, eps, phibar, cs, sn, k = 0.0, 0.0, 0.0, beta, -1.0, 0.0, 0
    while k < iterations and beta > 0:
        s = s.withColumn("v", _c("y") / beta)
        s = _times(a, s, "v", "av")
        s = s.withColumn("y", _c("av") - (beta / oldb) * _c("r1") if k else _c("av"))
        s = stored(s, "state")
        alfa = dots(s, d=(_c("v"), _c("y")))["d"]
        s = s.withColumn("y", _c("y") - (alfa / beta) * _c("r2"))
        s = s.withColumns({"r1": _c("r2"), "r2": _c("y")}).withColumn("y", F.abs("m") * _c("r2"))
        s = stored(s, "state")
        oldb, beta = beta, math.sqrt(max(dots(s, d=(_c("r2"), _c("y")))["d"], 0.0))
        oldeps = eps
        delta = cs * dbar + sn * alfa
        gbar = sn * dbar - cs * alfa
        eps, dbar = sn * beta, -cs * beta
        gamma = max(math.hypot(gbar, beta), floor)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        s = s.withColumn("w1", _c("w2")).withColumn("w2", _c("w"))
        s = s.withColumn("w", (_c("v") - oldeps * _c("w1") - delta * _c("w2")) / gamma)
        s = s.withColumn("x", _c("x") + phi * _c("w")).drop("v", "av", "w1")
        k += 1
    return Solved(s.select("i", "x"), abs(phibar), k)


def bicgstab(a: DataFrame, b: DataFrame, iterations: int = 50) -> Solved:
    """BiCGSTAB with Jacobi preconditioning for nonsymmetric systems; two products an iteration."""
    s = _start(a, b).withColumns({"r": _c("b"), "r0": _c("b"), "p": F.lit(0.0), "v": F.lit(0.0)})
    rho = alpha = omega = 1.0
    k, rr = 0, dots(s, rr=(_c("b"), _c("b")))["rr"]
    while k < iterations and rr > 0:
        new = dots(s, d=(_c("r0"), _c("r")))["d"]
        if not new or not omega:
            break
        beta = (new / rho) * (alpha / omega)
        s = s.withColumn("p", _c("r") + beta * (_c("p") - omega * _c("v"))).withColumn("ph", _c("m") * _c("p")).drop("v")
        s = stored(_times(a, s, "ph", "v"), "state")
        alpha = new / dots(s, d=(_c("r0"), _c("v")))["d"]
        s = s.withColumn("s", _c("r") - alpha * _c("v")).withColumn("sh", _c("m") * _c("s"))
        s = stored(_times(a, s, "sh", "t"), "state")
        d = dots(s, ts=(_c("t"), _c("s")), tt=(_c("t"), _c("t")))
        omega = d["ts"] / d["tt"] if d["tt"] else 0.0
        s = s.withColumns({"x": _c("x") + alpha * _c("ph") + omega * _c("sh"), "r": _c("s") - omega * _c("t")}).drop("s", "sh", "t", "ph")
        rho, k = new, k + 1
        rr = dots(s, rr=(_c("r"), _c("r")))["rr"]
    return Solved(s.select("i", "x"), math.sqrt(max(rr, 0.0)), k)


def back_substitute(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """y of an upper triangular system; a zero pivot gives 0."""
    y = np.zeros(len(g))
    for i in range(len(g) - 1, -1, -1):
        y[i] = (g[i] - h[i, i + 1 :] @ y[i + 1 :]) / h[i, i] if h[i, i] else 0.0
    return y


def gmres(a: DataFrame, b: DataFrame, restarts: int = 10, m: int = 30, tolerance: float = 1e-12) -> Solved:
    """Restarted GMRES(m): modified Gram-Schmidt, Givens rotations on the driver's small matrix."""
    s = _start(a, b)
    total, res = 0, math.inf
    for _ in range(restarts):
        s = stored(_times(a, s.select("i", "b", "m", "x"), "x", "ax").withColumn("q0", _c("m") * (_c("b") - _c("ax"))).drop("ax"), "state")
        norm = math.sqrt(dots(s, d=(_c("q0"), _c("q0")))["d"])
        if norm <= tolerance:
            res = norm
            break
        s = s.withColumn("q0", _c("q0") / norm)
        h, g, rot = np.zeros((m + 1, m)), np.zeros(m + 1), []
        g[0], n = norm, 0
        for j in range(m):
            s = _times(a, s, f"q{j}", "t").withColumn("t", _c("m") * _c("t"))
            for i in range(j + 1):  # one after the other: each step needs the one before
                s = stored(s, "state")
                h[i, j] = dots(s, d=(_c(f"q{i}"), _c("t")))["d"]
                s = s.withColumn("t", _c("t") - float(h[i, j]) * _c(f"q{i}"))
            s = stored(s, "state")
            norm = math.sqrt(dots(s, d=(_c("t"), _c("t")))["d"])
            h[j + 1, j] = norm
            s = s.withColumn(f"q{j + 1}", _c("t") * (1 / norm if norm else 0.0)).drop("t")
            for i, (c, sn) in enumerate(rot):
                h[i, j], h[i + 1, j] = c * h[i, j] + sn * h[i + 1, j], -sn * h[i, j] + c * h[i + 1, j]
            d = math.hypot(h[j, j], h[j + 1, j]) or 1.0
            c, sn = h[j, j] / d, h[j + 1, j] / d
            rot.append((c, sn))
            h[j, j], h[j + 1, j] = d, 0.0
            g[j], g[j + 1] = c * g[j], -sn * g[j]
            n, total = j + 1, total + 1
            res = abs(g[j + 1])
            if res <= tolerance or not norm:
                break
        y = back_substitute(h[:n, :n], g[:n])
        step = F.lit(0.0)
        for j in range(n):
            step = step + float(y[j]) * _c(f"q{j}")
        s = stored(s.withColumn("x", _c("x") + step).select("i", "b", "m", "x"), "state")
        if res <= tolerance:
            break
    return Solved(s.select("i", "x"), res, total)


#: Solvers by name, as a caller may add to.
SOLVERS: dict[str, Callable[..., Solved]] = {"cg": cg, "cr": cr, "minres": minres, "bicgstab": bicgstab, "gmres": gmres, "hpc_cg": hpc_cg}


#: Operations of each solver before its loop and in one iteration: matrix products (two for each entry), and vector
#: operations by the length of a vector: two for products, sums and scaled sums, one for elementwise and scalings.
WORK = {"cg": ((0, 3), (1, 11)), "cr": ((1, 2), (1, 13)), "minres": ((0, 2), (1, 18)), "bicgstab": ((0, 2), (2, 24)), "hpc_cg": ((0, 0), (1, 10))}


def flops(name: str, nnz, n, iterations: int, restart: int = 30):
    """Model of floating-point operations; an iteration of gmres is a restart of `restart` steps, whose j-th orthogonalises
    against j + 1 vectors. nnz and n are numbers or columns."""
    if name == "gmres":
        m = restart
        return iterations * ((1 + m) * 2 * nnz + (6 + 3 * m + 2 * m * (m + 1) + (m - 1) + 2 * m) * n)
    (p0, v0), (p, v) = WORK[name]
    return p0 * 2 * nnz + v0 * n + iterations * (p * 2 * nnz + v * n)
