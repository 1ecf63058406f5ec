"""Transformer layers over rows of vectors (arrays of double) and over long tables.

Array form: one row holds a position's vector, and a layer is a projection without a shuffle; weights
are small literal arrays or broadcast rows. Long form (row, channel, value) where a reduction runs
over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-5


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside a lambda an expression would be computed for each
    element."""
    return F.transform(F.array(value), f)[0]


def layernorm(x: Column, eps: float = EPS) -> Column:
    """struct(mean, rstd, out): biased variance."""

    def whole(m):
        var = mean(F.transform(x, lambda v: (v - m) * (v - m)))
        return let(1 / F.sqrt(var + eps), lambda r: F.struct(m.alias("mean"), r.alias("rstd"), F.transform(x, lambda v: (v - m) * r).alias("out")))

    return let(mean(x), whole)


def layernorm_backward(dout: Column, x: Column, eps: float = EPS) -> Column:
    """Gradient by x, with weight 1."""

    def grad(n):
        ab = F.struct(mean(dout).alias("a"), mean(F.zip_with(dout, n["out"], lambda p, q: p * q)).alias("b"))
        return let(ab, lambda c: F.zip_with(dout, n["out"], lambda d, z: (d - c["a"] - z * c["b"]) * n["rstd"]))

    return let(layernorm(x, eps), grad)


def rmsnorm(x: Column, eps: float = EPS) -> Column:
    return let(1 / F.sqrt(mean(F.transform(x, lambda v: v * v)) + eps), lambda r: F.transform(x, lambda v: v * r))


_ROOT = 0.7978845608028654  # sqrt(2 / pi)


def gelu(v: Column) -> Column:
    return 0.5 * v * (1 + F.tanh(_ROOT * (v + 0.044715 * v * v * v)))


def gelu_slope(v: Column) -> Column:
    t = F.tanh(_ROOT * (v + 0.044715 * v * v * v))
    return 0.5 * (1 + t) + 0.5 * v * (1 - t * t) * _ROOT * (1 + 3 * 0.044715 * v * v)


def swiglu(a: Column, b: Column) -> Column:
    return a * b / (1 + F.exp(-b))


def softmax(x: Column, low: float = -10000.0) -> Column:
    """Shifted by the maximum, which starts at `low`."""
    e = let(F.greatest(F.array_max(x), F.lit(low)), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(e, lambda y: let(total(y), lambda s: F.transform(y, lambda v: v / s)))


def online_softmax_state(x: Column) -> Column:
    """struct(m, s): running maximum and rescaled sum; two states merge the same way."""
    zero = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(z, v):
        m = F.greatest(z["m"], v)
        return F.struct(m.alias("m"), (z["s"] * F.exp(z["m"] - m) + F.exp(v - m)).alias("s"))

    return F.aggregate(x, zero, step)


def cross_entropy(probs: Column, target: Column) -> Column:
    return -F.log(F.greatest(F.element_at(probs, target.cast("int") + 1), F.lit(1e-300)))


def cross_entropy_softmax_gradient(probs: Column, target: Column, scale: float) -> Column:
    return F.transform(probs, lambda p, i: (p - F.when(i == target, 1.0).otherwise(0.0)) * scale)


def linear(x: Column, w: Column, bias: Column | None = None) -> Column:
    """out[o] = bias[o] + sum of x * w[o]: w is an array of rows."""
    dot = lambda row: total(F.zip_with(x, row, lambda p, q: p * q))
    return F.transform(w, lambda row, o: dot(row) + (F.get(bias, o) if bias is not None else 0.0))


def linear_backward(x: DataFrame, dout: DataFrame, w: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dx, dw, db) of long tables x (r, i, v), dout (r, o, g), w (o, i, w)."""
    dx = dout.join(w, "o").groupBy("r", "i").agg(F.sum(F.col("g") * F.col("w")).alias("dx"))
    dw = dout.join(x, "r").groupBy("o", "i").agg(F.sum(F.col("g") * F.col("v")).alias("dw"))
    return dx, dw, dout.groupBy("o").agg(F.sum("g").alias("db"))


def causal_attention(qkv: DataFrame, scale: float) -> DataFrame:
    """(b, h, t, out): qkv (b, h, t, q, k, v arrays). Range join t2 <= t inside (b, h), softmax over
    t2, weighted sum of values."""
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    left = qkv.select("b", "h", "t", "q")
    right = qkv.select("b", "h", F.col("t").alias("t2"), "k", "v")
    s = left.join(right, ["b", "h"]).where("t2 <= t").select("b", "h", "t", "t2", (dot(F.col("q"), F.col("k")) * scale).alias("s"), "v")
    row = Window.partitionBy("b", "h", "t")
    e = s.withColumn("e", F.exp(F.col("s") - F.greatest(F.max("s").over(row), F.lit(-10000.0)))).withColumn("p", F.col("e") / F.sum("e").over(row))
    long = e.select("b", "h", "t", "p", F.posexplode("v").alias("c", "v"))
    return long.groupBy("b", "h", "t", "c").agg(F.sum(F.col("p") * F.col("v")).alias("out"))


def rope(x: Column, pos: Column, base: float = 10000.0) -> Column:
    """Rotary position embedding of neighbouring pairs."""
    n = F.size(x)

    def turn(v, c):
        angle = pos / F.pow(F.lit(base), (c - c % 2) / n)
        other = F.get(x, c + 1 - 2 * (c % 2))
        return v * F.cos(angle) + F.when(c % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(x, turn)


def repeat_heads(kv: DataFrame, heads: int, kv_heads: int) -> DataFrame:
    """Grouped-query attention: query head h reads key/value head h div (heads / kv_heads)."""
    h = kv.sparkSession.range(heads).select(F.col("id").alias("h"), F.floor(F.col("id") / (heads // kv_heads)).alias("kv"))
    return F.broadcast(h).join(kv, "kv").drop("kv")  # heads


def lerp(a: Column, b: Column, weight: Column) -> Column:
    return a * (1 - weight) + b * weight


def permute(x: DataFrame, heads: int, size: int) -> DataFrame:
    """(part, b, h, n, d, v) of rows (b, n, x): x holds the three parts' heads end to end."""
    flat = x.select("b", "n", F.posexplode("x").alias("i", "v"))
    i, span = F.col("i"), heads * size
    return flat.select(F.floor(i / span).alias("part"), "b", (F.floor(i / size) % heads).alias("h"), "n", (i % size).cast("long").alias("d"), "v")


def unpermute(y: DataFrame, heads: int, size: int) -> DataFrame:
    """Rows (b, n, x) of what `permute` gave."""
    i = (F.col("part") * heads + F.col("h")) * size + F.col("d")
    g = y.groupBy("b", "n").agg(F.sort_array(F.collect_list(F.struct(i.alias("i"), "v"))).alias("k"))  # a vector each
    return g.select("b", "n", F.transform("k", lambda z: z["v"]).alias("x"))


def padded_softmax(x: Column, real: int) -> Column:
    """Softmax over the first `real` values; 0 in the padded tail."""
    p = softmax(F.slice(x, 1, real))
    return F.concat(p, F.transform(F.slice(x, real + 1, F.size(x) - real), lambda v: F.lit(0.0)))


def residual_layernorm(a: Column, b: Column, eps: float = EPS) -> Column:
    """struct(residual, out): the sum and its normalisation."""
    return let(F.zip_with(a, b, lambda p, q: p + q), lambda r: F.struct(r.alias("residual"), layernorm(r, eps)["out"].alias("out")))


def stretched(f: Column, factor: float = 8.0, low: float = 1.0, high: float = 4.0, context: float = 8192.0) -> Column:
    """Rotary frequencies for longer contexts: short waves stay, long ones are slowed by factor, those between are
    mixed. The defaults are fixed values of the published model."""
    wave = 2 * 3.141592653589793 / f
    mix = (context / wave - low) / (high - low)
    return F.when(wave < context / high, f).when(wave > context / low, f / factor).otherwise((1 - mix) * f / factor + mix * f)


def scatter_add(rows: DataFrame, at: str, value: str) -> DataFrame:
    """Sums by place: gradients of a table that rows were looked up in, or of a bias."""
    return rows.groupBy(at).agg(F.sum(value).alias(value))


def _dot(a: str, b: str) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def triangular(a: DataFrame) -> DataFrame:
    """(b, t, t2, s): products of a row's vector with those of the rows of its block up to itself."""
    left, right = a.select("b", "t", "x"), a.select("b", F.col("t").alias("t2"), F.col("x").alias("y"))
    return left.join(right, "b").where("t2 <= t").select("b", "t", "t2", _dot("x", "y").alias("s"))


def attention_backward(qkv: DataFrame, scale: float) -> tuple[DataFrame, DataFrame]:
    """(b, h, t, c, dq) and (b, h, t, c, dk, dv) of qkv (b, h, t, q, k, v, dout arrays): the weights are made again
    by the range join of the forward step rather than kept."""
    left = qkv.select("b", "h", "t", "q", "dout")
    right = qkv.select("b", "h", F.col("t").alias("t2"), "k", "v")
    s = left.join(right, ["b", "h"]).where("t2 <= t").withColumns({"s": _dot("q", "k") * scale, "dp": _dot("dout", "v")})
    row = Window.partitionBy("b", "h", "t")
    p = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(row))).withColumn("p", F.col("e") / F.sum("e").over(row))
    d = p.withColumn("ds", F.col("p") * (F.col("dp") - F.sum(F.col("p") * F.col("dp")).over(row)) * scale)
    by_q = d.select("b", "h", "t", "ds", F.posexplode("k").alias("c", "k")).groupBy("b", "h", "t", "c").agg(F.sum(F.col("ds") * F.col("k")).alias("dq"))
    both = d.select("b", "h", F.col("t2").alias("t"), "ds", "p", F.posexplode(F.arrays_zip("q", "dout")).alias("c", "z"))
    by_kv = both.groupBy("b", "h", "t", "c").agg(F.sum(F.col("ds") * F.col("z.q")).alias("dk"), F.sum(F.col("p") * F.col("z.dout")).alias("dv"))
    return by_q, by_kv


def cached_attention(q: DataFrame, cache: DataFrame, scale: float) -> DataFrame:
    """(b, h, c, out): one new position's q (b, h, q) over the cache (b, h, t, k, v) of all before and itself."""
    s = q.join(cache, ["b", "h"]).withColumn("s", _dot("q", "k") * scale)
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(Window.partitionBy("b", "h"))))
    flat = e.select("b", "h", "e", F.posexplode("v").alias("c", "v"))
    return flat.groupBy("b", "h", "c").agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("out"))
