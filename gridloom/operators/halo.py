"""Ownership and communication of a distributed matrix, as queries over (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(columns: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of join: the owner of column j is the rank with the largest start_row <= j.

    starts (rank, start_row) has a row for each rank; its stretches become intervals that meet end to
    end, and a range join on them keeps one row for each column.
    """
    from pyspark.sql import Window

    stretch = starts.withColumn("stop", F.coalesce(F.lead("start_row").over(Window.orderBy("start_row")), F.lit((1 << 63) - 1)))
    return columns.join(F.broadcast(stretch), (F.col("j") >= F.col("start_row")) & (F.col("j") < F.col("stop"))).drop("start_row", "stop")  # ranks


def externals(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(rank, j): columns that a rank reads and doesn't own. a (rank, i, j), rows (rank, i)."""
    return a.select("rank", "j").distinct().join(rows.select("rank", F.col("i").alias("j")), ["rank", "j"], "left_anti")


def exchange(ext: DataFrame, starts: DataFrame) -> DataFrame:
    """(dst, src, values): how many values each rank gets from each other one."""
    return owners(ext.withColumnRenamed("rank", "dst"), starts).groupBy("dst", F.col("rank").alias("src")).agg(F.count(F.lit(1)).alias("values"))


def neighbours(links: DataFrame) -> DataFrame:
    """(rank, neighbour): ranks that one receives from or sends to."""
    return links.select(F.col("dst").alias("rank"), F.col("src").alias("neighbour")).union(links.select("src", "dst")).distinct()


def block_dependencies(a: DataFrame, width: int) -> DataFrame:
    """(block, reads): blocks of x that a block of rows reads."""
    return a.select(F.floor(F.col("i") / width).alias("block"), F.floor(F.col("j") / width).alias("reads")).distinct()
