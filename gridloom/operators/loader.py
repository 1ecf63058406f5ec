"""The state of a sharded token loader, as relations: which shard, sample and rows a step reads.

A step's place follows from its number alone, so any step can be resumed from, on any executor, without
reading the steps before. Shards without a whole batch of all ranks are never read from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import BLOCK, accumulated
from .tokens import MersenneTwister


def cursor(spark: SparkSession, sizes: list[int], b: int, t: int, ranks: int, first: int, steps: int) -> DataFrame:
    """(step, epoch, shard, sample): `steps` steps from step `first`. sizes: tokens of each shard. When the last
    shard is read the first one follows, an epoch later."""
    each = [(n - 1) // (b * t * ranks) for n in sizes]
    begin = [sum(each[:i]) for i in range(len(each))]
    whole = sum(each)
    if not whole:
        return spark.createDataFrame([], "step long, epoch long, shard long, sample long")
    rows = [(i, lo, lo + n) for i, (lo, n) in enumerate(zip(begin, each)) if n]
    shards = spark.createDataFrame(rows, "shard long, lo long, hi long")
    s = spark.range(first, first + steps).select(F.col("id").alias("step"), F.floor(F.col("id") / whole).alias("epoch"), (F.col("id") % whole).alias("at"))
    return s.join(F.broadcast(shards), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("step", "epoch", "shard", (F.col("at") - F.col("lo")).alias("sample"))  # one row a shard


def batches(tokens: DataFrame, steps: DataFrame, b: int, t: int, ranks: int) -> DataFrame:
    """(step, epoch, shard, sample, rank, row, t, input, target) of tokens (shard, pos, tok) at the steps of `cursor`.
    A token is the input of one place and the target of the one before."""
    size = b * t * ranks
    at = tokens.select("shard", "pos", "tok", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("pos").alias("p")), F.struct(F.lit(1).alias("of"), (F.col("pos") - 1).alias("p")))).alias("x"))
    at = at.where("x.p >= 0").select("shard", F.floor(F.col("x.p") / size).alias("sample"), (F.col("x.p") % size).alias("p"), "x.of", "tok")
    both = at.groupBy("shard", "sample", "p").agg(F.max(F.when(F.col("of") == 0, F.col("tok"))).alias("input"), F.max(F.when(F.col("of") == 1, F.col("tok"))).alias("target"))
    rows = both.join(steps, ["shard", "sample"])
    return rows.select("step", "epoch", "shard", "sample", F.floor(F.col("p") / (b * t)).alias("rank"), F.floor(F.col("p") % (b * t) / t).alias("row"), (F.col("p") % t).alias("t"), "input", "target")


def permuted(spark: SparkSession, shards: int, samples: int, epochs: int, seed: int) -> DataFrame:
    """(epoch, place, shard, at, sample): the order of shards, which each epoch shuffles again, and that of samples within
    each shard as it comes up, all drawn from one generator in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, rows, order = MersenneTwister(s), [], range(shards)
                for epoch in range(e):
                    order = g.shuffled(order)
                    for place, shard in enumerate(order):
                        rows += [(epoch, place, shard, at, x) for at, x in enumerate(g.permutation(samples))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["epoch", "place", "shard", "at", "sample"])

    return spark.createDataFrame([(seed, epochs)], "seed long, epochs long").mapInArrow(run, "epoch long, place long, shard long, at long, sample long")


def evaluation_rows(examples: DataFrame, rows: int) -> DataFrame:
    """(idx, batch, row, t, mask): examples (idx, ctx tokens, endings: tokens of each of four) laid four rows an
    example, rows div 4 examples a batch; mask marks the places whose target is a token of the ending."""
    each = rows // 4
    e = accumulated(examples, ["idx"]).withColumnRenamed("_k", "k").select("idx", "ctx", "k", F.posexplode("endings").alias("c", "n"))
    e = e.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ctx") + F.col("n") - 1)))
    mask = (F.col("t") >= F.col("ctx") - 1) & (F.col("t") < F.col("ctx") - 1 + F.col("n"))
    return e.select("idx", F.floor(F.col("k") / each).alias("batch"), ((F.col("k") % each) * 4 + F.col("c")).cast("long").alias("row"), "t", mask.alias("mask"))


def split(rows: DataFrame, key: str, parts: int, block: int = BLOCK) -> DataFrame:
    """rows with rank: in order of key (null first), ceil(n / parts) a rank, the last ones cropped."""
    out = accumulated(rows, [key], block=block)
    return out.withColumn("rank", F.floor(F.col("_k") / F.ceil(F.col("_n") / parts))).drop("_k", "_n")


def multiset_difference(first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """(v, first, second): values that the two tables don't hold equally often; null for not at all."""
    a = first.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("first"))
    b = second.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("second"))
    return a.join(b, "v", "full").where(~F.col("first").eqNullSafe(F.col("second")))
