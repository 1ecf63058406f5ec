"""Tiled dense Cholesky factorisation, right-looking, over tiles (bi, bj, data).

Tiles are row-major arrays. For each diagonal k one tile is factored, the panel below it is solved
against that tile, and the trailing tiles are updated from pairs of panel tiles; each step is a join
on the panel, and NumPy works inside a tile. Tiles above the diagonal are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordering import accumulated

TILE = "bi long, bj long, data array<double>"


def to_tiles(a: DataFrame, ts: int) -> DataFrame:
    """Tiles on and below the diagonal of a dense matrix (i, j, v)."""
    t = a.select(F.floor(F.col("i") / ts).alias("bi"), F.floor(F.col("j") / ts).alias("bj"), ((F.col("i") % ts) * ts + F.col("j") % ts).alias("k"), "v")
    return t.where("bi >= bj").groupBy("bi", "bj").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("data"))


def from_tiles(t: DataFrame, ts: int) -> DataFrame:
    x = t.select("bi", "bj", F.posexplode("data").alias("k", "v"))
    return x.select((F.col("bi") * ts + F.floor(F.col("k") / ts)).alias("i"), (F.col("bj") * ts + F.col("k") % ts).alias("j"), "v")


def _square(x, ts: int) -> np.ndarray:
    return np.asarray(x, np.float64).reshape(ts, ts)


def factor(tiles: DataFrame, nt: int, ts: int) -> DataFrame:
    """The tiles of L with A = L L'. Raises if a diagonal tile isn't positive definite."""

    def potrf(batches):
        for p in batches:
            p["data"] = [np.linalg.cholesky(np.tril(_square(x, ts)) + np.tril(_square(x, ts), -1).T).ravel() for x in p["data"]]
            yield p

    def trsm(batches):
        for p in batches:
            p["data"] = [np.linalg.solve(_square(l, ts), _square(x, ts).T).T.ravel() for x, l in zip(p["data"], p["ldata"])]
            yield p[["bi", "bj", "data"]]

    def update(batches):
        for p in batches:
            p["data"] = [(_square(x, ts) - _square(a, ts) @ _square(b, ts).T).ravel() for x, a, b in zip(p["data"], p["adata"], p["bdata"])]
            yield p[["bi", "bj", "data"]]

    done = None
    rest = tiles
    for k in range(nt):
        rest = rest.repartition("bi", "bj") if k == 0 else rest
        head = stored(rest.where(f"bi = {k} and bj = {k}").mapInPandas(potrf, TILE), "tile")
        panel = rest.where(f"bj = {k} and bi > {k}").crossJoin(F.broadcast(head.select(F.col("data").alias("ldata"))))  # one tile
        panel = stored(panel.mapInPandas(trsm, TILE), "panel")
        done = head.unionByName(panel) if done is None else done.unionByName(head).unionByName(panel)
        a = panel.select("bi", F.col("data").alias("adata"))
        b = panel.select(F.col("bi").alias("bj"), F.col("data").alias("bdata"))
        if k < nt - 1:
            rest = stored(rest.where(f"bj > {k}").join(a, "bi").join(b, "bj").select("bi", "bj", "data", "adata", "bdata").mapInPandas(update, TILE), "tiles")
    return done


def panels(rows: DataFrame, key: str, x: str, ts: int, size: int = 256) -> DataFrame:
    """(bi, k, data): rows of arrays cut into blocks k of `size` rows, in order of key, and ts columns each, row by row. The last
    columns are filled with zeros; null arrays are left out."""
    r = accumulated(rows.where(F.col(x).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x")), ["key"])
    block = r.groupBy(F.floor(F.col("_k") / size).alias("k")).agg(F.sort_array(F.collect_list(F.struct("_k", "x"))).alias("r"))  # size rows
    wide = F.ceil(F.aggregate("r", F.lit(0), lambda n, v: F.greatest(n, F.size(v["x"]))) / ts)
    block = block.select("k", "r", F.explode(F.sequence(F.lit(0).cast("long"), wide - 1)).alias("bi"))
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.lit(ts)), lambda c: F.coalesce(F.get(v["x"], (F.col("bi") * ts + c - 1).cast("int")), F.lit(0.0)))
    return block.select("bi", "k", F.flatten(F.transform("r", cut)).alias("data"))


def gram(a: DataFrame, ts: int, turned: bool = False) -> DataFrame:
    """Tiles on and below the diagonal of the sum over k of A_k' A_k, of panels (bi, k, data): pairs of tiles that
    share k are joined; a task sums what it has of each tile first. turned: tiles are stored the other way round, so the
    sum is of A_k A_k'."""

    def products(batches):
        own: dict[tuple[int, int], np.ndarray] = {}
        for p in batches:
            for bi, bj, x, y in zip(p["bi"], p["bj"], p["adata"], p["bdata"]):
                x, y = (_square(v, ts).T if turned else np.asarray(v, np.float64).reshape(-1, ts) for v in (x, y))
                own[bi, bj] = own.get((bi, bj), 0.0) + x.T @ y
        if own:
            yield pd.DataFrame({"bi": [i for i, _ in own], "bj": [j for _, j in own], "data": [v.ravel() for v in own.values()]})

    b = a.select(F.col("bi").alias("bj"), "k", F.col("data").alias("bdata"))
    pairs = a.select("bi", "k", F.col("data").alias("adata")).join(b, "k").where("bi >= bj")
    parts = pairs.select("bi", "bj", "adata", "bdata").mapInPandas(products, TILE)
    each = parts.select("bi", "bj", F.posexplode("data").alias("p", "v")).groupBy("bi", "bj", "p").agg(F.sum("v").alias("v"))
    return each.groupBy("bi", "bj").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("data"))  # a tile


def flops(n: int) -> float:
    return n**3 / 3


def sequential(a: np.ndarray) -> np.ndarray:
    """Row by row, as a plain reference."""
    n = len(a)
    low = np.zeros_like(a)
    for j in range(n):
        low[j, j] = np.sqrt(a[j, j] - low[j, :j] @ low[j, :j])
        for i in range(j + 1, n):
            low[i, j] = (a[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
    return low


