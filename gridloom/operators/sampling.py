"""Choosing from rows of logits or probabilities in long form (row, i, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_k(logits: DataFrame, row: str, value: str, k: int) -> DataFrame:
    """Entries not below the k-th largest; ties stay."""
    return logits.withColumn("_r", F.rank().over(Window.partitionBy(row).orderBy(F.desc(value)))).where(F.col("_r") <= k).drop("_r")


def top_p(probs: DataFrame, row: str, i: str, p: str, most: float) -> DataFrame:
    """Entries, largest first, while those before them sum to at most `most`."""
    before = Window.partitionBy(row).orderBy(F.desc(p), i).rowsBetween(Window.unboundedPreceding, -1)
    return probs.withColumn("_c", F.coalesce(F.sum(p).over(before), F.lit(0.0))).where(F.col("_c") <= most).drop("_c")


def sample_cdf(probs: DataFrame, coins: DataFrame, row: str, i: str, p: str) -> DataFrame:
    """The first index at which a row's coin is below the running sum, else the last index."""
    run = Window.partitionBy(row).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    c = probs.withColumn("_c", F.sum(p).over(run)).join(coins, row)
    return c.groupBy(row).agg(F.coalesce(F.min(F.when(F.col("coin") < F.col("_c"), F.col(i))), F.max(i)).alias("pick"))


def greedy(logits: DataFrame, row: str, i: str, value: str) -> DataFrame:
    """The index of the largest value, the least of equal ones."""
    return logits.groupBy(row).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(i)).alias("i"))).alias("b")).select(row, (-F.col("b.i")).alias("pick"))


class XorShift:
    """xorshift* of 64 bits: u32 and f32 in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def u32(self) -> int:
        s = self.state
        s ^= s >> 12
        s ^= (s << 25) & 0xFFFFFFFFFFFFFFFF
        s ^= s >> 27
        self.state = s
        return ((s * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF) >> 32

    def f32(self) -> float:
        return (self.u32() >> 8) / 16777216.0


def tempered(x: Column, temperature: float) -> Column:
    """Softmax of logits by temperature: an array."""
    from .layers import softmax

    return softmax(F.transform(x, lambda v: v / temperature))


def until_stop(tokens: Column, prompt: int, most: int, stops: tuple[int, ...]) -> Column:
    """The prompt and at most `most` tokens after it, up to the first stop token, which is left out."""
    whole = F.slice(tokens, 1, prompt + most)
    stop = F.array_min(F.transform(F.filter(F.transform(whole, lambda v, i: F.when((i >= prompt) & v.isin(*stops), i)), lambda i: i.isNotNull()), lambda i: i))
    return F.when(stop.isNull(), whole).otherwise(F.slice(whole, F.lit(1), F.coalesce(stop, F.lit(0))))


#: Fixed values of a published noise function.
NOISE = (0xD2A80A3F, 0xA884F197, 0x6C736F4B, 0xB79F3ABB, 0x1B56C4F5)
_LOW = 0xFFFFFFFF


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2^32 in longs: the high half of k by the low one of x overflows nothing."""
    low, high = k & 0xFFFF, k >> 16
    return (x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


#: Factor of the generator's output, as XorShift has it (a fixed value).
STAR = 0x2545F4914F6CDD1D


def next_state(s: Column) -> Column:
    """The state after s of the generator of XorShift, as a signed long of the same bits."""
    s = s.bitwiseXOR(F.shiftrightunsigned(s, 12))
    s = s.bitwiseXOR(F.shiftleft(s, 25))
    return s.bitwiseXOR(F.shiftrightunsigned(s, 27))


def bits_of(s: Column) -> Column:
    """The 32 bits that a state gives: the high half of s * STAR modulo 2^64, by halves that overflow nothing."""
    high, low = F.shiftrightunsigned(s, 32), s.bitwiseAND(F.lit(_LOW))
    least = STAR & _LOW
    carried = F.shiftright(F.shiftright(low, 16) * least + F.shiftright(low.bitwiseAND(F.lit(0xFFFF)) * least, 16), 16)
    return (carried + _times(high, least) + _times(low, STAR >> 32)).bitwiseAND(F.lit(_LOW))


def drawn(seed: Column, n: int) -> Column:
    """The first n draws of each row's own seed, as an array of (u32, f32); of 0 and of null, those of state 0 and null."""
    start = F.struct(seed.cast("long").alias("s"), F.array().cast("array<bigint>").alias("bits"))

    def step(a: Column, _: Column) -> Column:
        return F.struct(next_state(a["s"]).alias("s"), F.concat(a["bits"], F.array(bits_of(next_state(a["s"])))).alias("bits"))

    bits = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda a: a["bits"])
    return F.transform(bits, lambda b: F.struct(b.alias("u32"), (F.shiftright(b, 8) / 16777216.0).alias("f32")))


def noise(position: Column, seed: Column) -> Column:
    """32 random bits of a position and a seed, the same wherever they are asked for."""
    a, b, c, d, e = NOISE
    mixed = lambda m, n: m.bitwiseXOR(F.shiftright(m, n))
    m = (_times(position.bitwiseAND(F.lit(_LOW)), a) + seed).bitwiseAND(F.lit(_LOW))
    m = (mixed(m, 9) + b).bitwiseAND(F.lit(_LOW))
    m = _times(mixed(m, 11), c)
    m = (mixed(m, 13) + d).bitwiseAND(F.lit(_LOW))
    return mixed(_times(mixed(m, 15), e), 17)


def stochastic_bf16(values, random):
    """NumPy: float32 values to half width, up where the bits that go exceed 16 random ones, so that the mean stays."""
    import numpy as np

    bits = np.asarray(values, "<f4").view("<u4")
    up = (bits & np.uint32(0xFFFF)) > (np.asarray(random).astype(np.uint32) & np.uint32(0xFFFF))
    # all the bits that go are set or cleared; what is left is rounded to the nearest
    full = np.where(up, bits | np.uint32(0xFFFF), bits & np.uint32(0xFFFF0000))
    from ..sources.binary_files import to_bf16

    return to_bf16(full.view("<f4"))


def rounded_bf16(df: DataFrame, value: Column, random: Column, out: str) -> DataFrame:
    """`stochastic_bf16` in columns: df with out, a number, taken as float32, at 8 of its 24 leading bits; up where the bits
    that go exceed the low 16 of random. Exponents come from a logarithm and are set right by comparison; scaling by powers
    of two is exact. Null, 0, NaN and infinities stay. Each step is a projection of its own, so that nothing is computed twice."""
    two = lambda x: F.pow(F.lit(2.0), x)
    d = df.withColumn("_v", value.cast("float").cast("double")).withColumn("_r", random.bitwiseAND(F.lit(0xFFFF)))
    d = d.withColumn("_e", F.floor(F.log2(F.abs("_v"))).cast("double"))
    size, e = F.abs("_v"), F.col("_e")
    d = d.withColumn("_e", F.greatest(F.when(size >= two(e + 1), e + 1).when(size < two(e), e - 1).otherwise(e), F.lit(-126.0)))  # below, leading bits are 0
    d = d.withColumn("_w", (size * two(23 - e)).try_cast("long"))
    up = F.when(F.col("_w").bitwiseAND(F.lit(0xFFFF)) > F.col("_r"), 1).otherwise(0)
    d = d.withColumn("_w", (F.shiftright("_w", 16) + up) * two(e - 7))
    whole = F.when(F.col("_w") >= 2.0**128, F.lit(float("inf"))).otherwise(F.col("_w"))
    stays = (F.col("_v") == 0) | F.isnan("_v") | (size == float("inf"))
    return d.withColumn(out, F.when(stays, F.col("_v")).otherwise(F.signum("_v") * whole)).drop("_v", "_r", "_e", "_w")


def normals(spark: SparkSession, seeds, n: int) -> DataFrame:
    """(seed, i, uniform, normal): n numbers of each seed's generator. Normal ones come by pairs of lanes eight apart
    in blocks of sixteen; the last sixteen are drawn again where n isn't a multiple."""

    def run(batches):
        import math

        import pyarrow as pa

        from .tokens import MersenneTwister

        for batch in batches:
            for seed in batch.column(0).to_pylist():
                g = MersenneTwister(seed)
                draw = lambda: (g.u32() & 0xFFFFFF) / float(1 << 24)  # noqa: B023, E731
                u = [draw() for _ in range(n)]
                z = list(u)

                def pair(at: int) -> None:
                    for k in range(at, at + 8):
                        r, turn = math.sqrt(-2 * math.log(1 - z[k])), 2 * math.pi * z[k + 8]  # noqa: B023
                        z[k], z[k + 8] = r * math.cos(turn), r * math.sin(turn)  # noqa: B023

                for at in range(0, n - 15, 16):
                    pair(at)
                if n % 16 and n >= 16:
                    z[n - 16 :] = [draw() for _ in range(16)]
                    pair(n - 16)
                yield pa.RecordBatch.from_arrays([pa.array([seed] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(u), pa.array(z)], names=["seed", "i", "uniform", "normal"])

    return spark.createDataFrame([(s,) for s in seeds], "seed long").mapInArrow(run, "seed long, i long, uniform double, normal double")
