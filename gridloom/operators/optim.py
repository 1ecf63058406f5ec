"""Optimiser steps, learning-rate schedules and model arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tensors whose weights decay: the two-dimensional ones (fixed values).
DECAYED = (0, 1, 4, 6, 10, 12)


def adamw(p: Column, g: Column, m: Column, v: Column, step: int, lr: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: Column | float = 0.0) -> dict[str, Column]:
    """Updated p, m, v: bias-corrected moments, decay apart from the gradient."""
    m2, v2 = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
    d = F.lit(decay) if isinstance(decay, float) else decay
    p2 = p - lr * ((m2 / (1 - beta1**step)) / (F.sqrt(v2 / (1 - beta2**step)) + eps) + d * p)
    return {"p": p2, "m": m2, "v": v2}


def clip_scale(gradients: DataFrame, g: str, most: float = 1.0) -> DataFrame:
    """norm and the factor that brings it down to `most`."""
    n = gradients.agg(F.sqrt(F.sum(F.col(g) * F.col(g))).alias("norm"))
    return n.select("norm", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(most), F.col("norm")), F.lit(1.0))).alias("scale"))


def cosine(step: Column, lr: float, warmup: int, total: int, final: float) -> Column:
    at = (step - warmup) / float(total - warmup)
    return F.when(step < warmup, lr * (step + 1) / warmup).otherwise(lr * final + 0.5 * (1 + F.cos(math.pi * at)) * (lr - lr * final))


def linear(step: Column, lr: float, warmup: int, total: int, final: float) -> Column:
    at = (step - warmup) / float(total - warmup)
    return F.when(step < warmup, lr * (step + 1) / warmup).otherwise(lr - (lr - lr * final) * at)


def constant(step: Column, lr: float, warmup: int, total: int, final: float) -> Column:
    return F.lit(lr) + 0.0 * step


def warmup_stable_decay(step: Column, lr: float, warmup: int, total: int, final: float) -> Column:
    """Flat until the last fifth, then down with the root of its share."""
    point = int(0.8 * total)
    at = (step - point) / float(total - point)
    return F.when(step < warmup, lr * (step + 1) / warmup).when(step < point, F.lit(lr)).otherwise(lr * final + (1 - F.sqrt(F.greatest(at, F.lit(0.0)))) * (lr - lr * final))


SCHEDULES = {"cosine": cosine, "linear": linear, "constant": constant, "wsd": warmup_stable_decay}


def flops_per_token(parameters: Column, layers: Column, channels: Column, context: Column) -> Column:
    return 6 * parameters + 6 * layers * channels * context


def skip(z: Column, most: float) -> Column:
    """Whether an update is left out: its loss or gradient lies too far from the last ones; never where z is null."""
    return F.coalesce(F.abs(z) > most, F.lit(False))


def accumulated(gradients: DataFrame, rows: int, micro_steps: int) -> DataFrame:
    """(step, i, g) of (step, micro, i, g): each micro-batch's mean over its rows, scaled by the number of micro-steps
    and summed; a step begins at zero."""
    micro = gradients.groupBy("step", "micro", "i").agg((F.sum("g") / (rows * micro_steps)).alias("g"))
    return micro.groupBy("step", "i").agg(F.sum("g").alias("g"))


#: Published peaks of the largest model of each series in 10^12 operations a second by precision, its clock in MHz and
#: its matrix units (fixed values); a device's own units and clock scale them.
SERIES = {
    "volta": {"fp16": 125.0, "mhz": 1530.0, "units": 640.0},
    "ampere": {"fp32": 156.0, "bf16": 312.0, "fp16": 312.0, "mhz": 1410.0, "units": 432.0},
    "hopper": {"fp32": 378.0, "bf16": 756.0, "fp16": 756.0, "mhz": 1620.0, "units": 456.0},
    "ada": {"fp32": 82.6, "bf16": 165.2, "fp16": 165.2, "mhz": 2520.0, "units": 512.0},
}
DEVICES = {
    "Tesla V100-SXM2-16GB": ("volta", 640, 1530),
    "NVIDIA A100-SXM4-40GB": ("ampere", 432, 1410),
    "NVIDIA A100-SXM4-80GB": ("ampere", 432, 1410),
    "NVIDIA GeForce RTX 4090": ("ada", 512, 2520),
    "NVIDIA GeForce RTX 4080": ("ada", 304, 2505),
    "NVIDIA H100 PCIe": ("hopper", 456, 1620),
    "NVIDIA H100 80GB HBM3": ("hopper", 528, 1830),
}


def promised(device: str, precision: str) -> float | None:
    """10^12 operations a second that a device promises; None where it isn't known."""
    if device not in DEVICES or precision not in SERIES[DEVICES[device][0]]:
        return None
    series, units, mhz = DEVICES[device]
    s = SERIES[series]
    return s[precision] * (units / s["units"]) * (mhz / s["mhz"])


def promised_table(spark: SparkSession, precision: str) -> DataFrame:
    """(device, tflops), null where the precision isn't known of it: what a utilisation is told against."""
    return spark.createDataFrame([(d, promised(d, precision)) for d in DEVICES], "device string, tflops double")


def retained(files: DataFrame, marker: str, last: int, every: int) -> DataFrame:
    """(step, done, resume, keep) of a folder's files (step, kind): a step is done when its marker is there, the last
    done one is resumed from; the `last` newest and each multiple of `every` stay."""
    s = files.groupBy("step").agg(F.max(F.col("kind") == marker).alias("done"))
    r = F.row_number().over(Window.partitionBy("done").orderBy(F.desc("step")))  # steps that were saved: some thousands
    s = s.withColumn("r", F.when(F.col("done"), r))
    first = F.coalesce(F.col("r") == 1, F.lit(False))
    return s.select("step", "done", first.alias("resume"), (F.col("done") & ((F.col("r") <= last) | (F.col("step") % every == 0))).alias("keep"))


def initial(spark: SparkSession, depths: list[int]) -> DataFrame:
    """(layers, tensor, mean, spread): normal weights of spread 0.02, those that end a residual branch less by the root
    of their number; normalisation weights 1, biases 0 (fixed values of the published model)."""
    from ..sources.binary_files import TENSORS

    rows = []
    for n in depths:
        for t in TENSORS:
            weight = t in ("wte", "wpe", "qkvw", "fcw")
            ends = t in ("attprojw", "fcprojw")
            rows.append((n, t, 1.0 if t in ("ln1w", "ln2w", "lnfw") else 0.0, 0.02 if weight else 0.02 / math.sqrt(2 * n) if ends else 0.0))
    return spark.createDataFrame(rows, "layers long, tensor string, mean double, spread double")


def transposed(matrix: DataFrame) -> DataFrame:
    """(row, col, v) with rows and columns exchanged."""
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def reduce_blocks(gradients: DataFrame, size: int) -> DataFrame:
    """(block, mean, ranks) of (rank, i, g): the mean over ranks of blocks of `size` neighbouring values."""
    return gradients.groupBy(F.floor(F.col("i") / size).alias("block")).agg(F.avg("g").alias("mean"), F.countDistinct("rank").alias("ranks"))


def shard_size(n: int, ranks: int, stage: int = 1) -> int:
    """Values of a tensor of n that each rank updates: all of them at stage 0 or where the ranks don't divide n. Later stages than
    the first, which share gradients and weights out, are refused."""
    if stage not in (0, 1):
        raise ValueError(f"optimiser state alone is shared out, not what stage {stage} does")
    return n if stage == 0 or n % ranks else n // ranks


def reduce_scatter(gradients: DataFrame, size: int) -> DataFrame:
    """(shard, first, i, g) of (rank, i, g): the mean over ranks of each value's sum, at the rank that updates it."""
    own = gradients.groupBy("rank", "i").agg(F.sum("g").alias("g")).groupBy("i").agg(F.avg("g").alias("g"))
    shard = F.floor(F.col("i") / size)
    return own.select(shard.alias("shard"), (shard * size).alias("first"), "i", "g")


def lower_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """diff: the largest difference of two matrices (i, j, v) on and below the diagonal."""
    return a.where("j <= i").join(b.withColumnRenamed("v", "w"), ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("diff"))
