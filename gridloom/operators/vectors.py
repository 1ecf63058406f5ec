"""Vectors and sparse matrices as relations: vector (i, ...), matrix (i, j, v).

Vectors with one key are columns of one state table, so element-wise operators are projections and
several reductions share one aggregate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .ordering import BLOCK, accumulated


def spmv(a: DataFrame, x: DataFrame, value: str, out: str = "y") -> DataFrame:
    """y_i = sum of v * x_j over row i. Rows without entries are absent."""
    return a.join(x.select(F.col("i").alias("j"), F.col(value).alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias(out))


def laid_out(a: DataFrame, by: str = "j", buckets: int = 64) -> DataFrame:
    """a as a stored table in buckets of a column: a join on that column reads it as it lies, so that products by the
    same matrix shuffle the vector only."""
    name = f"matrix_{uuid.uuid4().hex}"
    a.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", scratch(a.sparkSession, "matrix")).saveAsTable(name)
    return a.sparkSession.table(name)


def vmul(d: Column, x: Column) -> Column:
    return d * x


def scal(s: float, x: Column) -> Column:
    return F.lit(s) * x


def axpy(y: Column, s: float, x: Column, sign: int = 1) -> Column:
    return y + F.lit(sign * s) * x


def xpby(x: Column, s: float, y: Column) -> Column:
    return x + F.lit(s) * y


def waxpby(alpha: float, x: Column, beta: float, y: Column) -> Column:
    return F.lit(alpha) * x + F.lit(beta) * y


def cutoff(v: Column, least: float) -> Column:
    """0 where the magnitude is below least."""
    return F.when(F.abs(v) < least, 0.0).otherwise(v)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def dots(state: DataFrame, **pairs: tuple[Column, Column]) -> dict[str, float]:
    """Several inner products over one state table in a single aggregate; 0 for an empty table."""
    row = state.agg(*[F.coalesce(F.sum(a * b), F.lit(0.0)).alias(k) for k, (a, b) in pairs.items()]).first()
    return row.asDict()


def residual_norms(state: DataFrame, ax: str, b: str, x: str, exact: str) -> DataFrame:
    """Relative residual and relative error, four sums in one aggregate."""
    sq = lambda c: F.sum(c * c)
    r, e = F.col(b) - F.col(ax), F.col(x) - F.col(exact)
    s = state.agg(sq(r).alias("r"), sq(F.col(b)).alias("b"), sq(e).alias("e"), sq(F.col(exact)).alias("x"))
    return s.select(F.sqrt(F.col("r") / F.col("b")).alias("rel_residual"), F.sqrt(F.col("e") / F.col("x")).alias("rel_error"))


def max_difference(state: DataFrame, a: str, b: str) -> DataFrame:
    return state.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_diff"))


def diagonal(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, d): the diagonal, 0 where absent; rows has every i."""
    d = a.where("i = j").groupBy("i").agg(F.first("v").alias("d"))
    return rows.select("i").join(d, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d"))


def zero_diagonals(a: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: rows, nnz (entries there are, zeros too), zeros (rows whose diagonal is absent or 0) and nnz_per_row."""
    n = a.agg(F.count(F.lit(1)).alias("nnz"))
    d = diagonal(a, rows).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("d") == 0).alias("zeros"))
    return d.crossJoin(F.broadcast(n)).select("rows", "nnz", "zeros", F.try_divide("nnz", "rows").alias("nnz_per_row"))  # one row each


def shift_diagonal(a: DataFrame, sigma: float) -> DataFrame:
    return a.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") - sigma).otherwise(F.col("v")))


def mirrored(a: DataFrame, sign: int = 1) -> DataFrame:
    """Entries and those off the diagonal once more across it."""
    return a.unionByName(a.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("v")).alias("v")))


def row_pointers(a: DataFrame, rows: DataFrame, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """(i, start, count) of a compressed-row layout, rows ascending, a null row before all others. Rows are
    counted up in blocks of `block`, or in as many as `blocks` says."""
    if blocks:
        block = max(1, -(-rows.count() // blocks))
    counted = a.groupBy(F.col("i").alias("_i")).agg(F.count(F.lit(1)).alias("count"))
    count = rows.select("i").join(counted, F.col("i").eqNullSafe(F.col("_i")), "left").select("i", F.coalesce("count", F.lit(0)).alias("count"))
    return accumulated(count, ["i"], sums={"start": F.col("count")}, block=block).select("i", "start", "count")


def place_in_row(a: DataFrame) -> DataFrame:
    """(i, j, k): the place of each entry in its row by column."""
    return a.select("i", "j", (F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1).cast("long").alias("k"))


def block_of(i: Column, n: int, parts: int) -> Column:
    """Tile of index i when n is cut into `parts` of equal ceiling size."""
    return F.floor(i / -(-n // parts))


def contiguous_owner(i: Column, n: int, parts: int) -> Column:
    """Owner of row i when the first n mod parts owners hold one row more."""
    q, r = divmod(n, parts)
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / max(q, 1)))
