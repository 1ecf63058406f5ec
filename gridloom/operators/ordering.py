"""Running numbers and sums over an order, without a task that gets a whole series.

Rows are dealt out by ranges of (series, order, place in the input), which sampling makes about equally
large whatever the keys are: outlying, negative, equal or null. Each range is a block. Sums are run inside
blocks, and the blocks' totals in turn. The ranges are written once, since sampling may draw others when a
task runs again.

Nulls come first, in series and order; rows that are equal in both follow their places in the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a block, about.
BLOCK = 100_000
#: Totals up to which their table is broadcast.
SMALL = 200_000


def ranged(df: DataFrame, order: Sequence[str | Column], partition: Sequence[str] = (), block: int = BLOCK) -> tuple[DataFrame, list[Column]]:
    """df as a stored table with _b, the block of a row, and _o, its place in the input; and the columns
    that order a block."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = {f"_o{i}": k for i, k in enumerate(keys)}
    d = df.withColumns({**named, "_o": F.monotonically_increasing_id()})
    by = [F.asc_nulls_first(c) for c in [*partition, *named, "_o"]]
    parts = max(1, -(-df.count() // block))
    return stored(d.repartitionByRange(parts, *by).withColumn("_b", F.spark_partition_id()), "blocks"), by[len(partition) :]


def accumulated(df: DataFrame, order: Sequence[str | Column], partition: Sequence[str] = (), sums: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """df with _k, a row's number in its series from 0, _n, the series' rows, and for each of `sums` its total over
    the rows before (0 for the first; nulls count as 0)."""
    d, by = ranged(df, order, partition, block)
    sums = {k: F.coalesce(v, F.lit(0)) for k, v in (sums or {}).items()}
    total = d.groupBy(*partition, "_b").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(v).alias(f"_t{i}") for i, v in enumerate(sums.values())])
    series = Window.partitionBy(*partition)
    before = series.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    total = stored(
        total.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(partition)], F.col("_b").alias("_b2"), base("_c").alias("_base"), F.sum("_c").over(series).alias("_n"), *[base(f"_t{i}").alias(f"_u{i}") for i in range(len(sums))]),
        "block_totals",
    )
    # a task for each block, whatever the plan would put together by compressed sizes
    d = d.repartition(1 + (total.agg(F.max("_b2")).first()[0] or 0), "_b")
    inside = Window.partitionBy(*partition, "_b").orderBy(*by)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumns({"_r": F.row_number().over(inside) - 1, **{f"_v{i}": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for i, v in enumerate(sums.values())}})
    same = F.col("_b") == F.col("_b2")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = out.join(F.broadcast(total) if total.count() <= SMALL else total, same)
    return out.select(*df.columns, (F.col("_r") + F.col("_base")).cast("long").alias("_k"), F.col("_n").cast("long").alias("_n"), *[(F.col(f"_v{i}") + F.col(f"_u{i}")).alias(k) for i, k in enumerate(sums)])
