"""Queries of transformer layers, optimiser and sampling, on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers, optim, sampling
from ..session import table
from .catalog import query

X = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _x(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _long(df, column: str, name: str):
    return df.select("vec_id", F.posexplode(column).alias("c", name)).select("vec_id", F.col("c").cast("long").alias("c"), F.round(name, 6).alias(name))


def _rows(value: str, name: str, more: str = "") -> str:
    """One row for each element of a list expression over x."""
    return f"SELECT vec_id, CAST(c - 1 AS BIGINT) AS c, round(v, 6) AS {name} FROM (SELECT vec_id, unnest({value}) AS v, unnest(range(1, 65)) AS c FROM (SELECT *{more} FROM {X}))"


@query("A10 L02", "SELECT vec_id, round(list_avg(x), 6) AS mean, round(1 / sqrt(list_var_pop(x) + 1e-5::DOUBLE), 6) AS rstd FROM " + X)
def layernorm_stats(spark, sf_dir):
    n = layers.layernorm(F.col("x"))
    return _x(spark, sf_dir).select("vec_id", F.round(n["mean"], 6).alias("mean"), F.round(n["rstd"], 6).alias("rstd"))


@query("A10 L02", _rows("list_transform(x, lambda v: (v - m) * r)", "out", ", list_avg(x) AS m, 1 / sqrt(list_var_pop(x) + 1e-5::DOUBLE) AS r"))
def layernorm_rows(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", layers.layernorm(F.col("x"))["out"]), "y", "out")


@query("A11", _rows("list_transform(x, lambda v: (v * v - a - (v - m) * r * b) * r)", "dx", ", list_avg(x) AS m, 1 / sqrt(list_var_pop(x) + 1e-5::DOUBLE) AS r, list_avg(list_transform(x, lambda u: u * u)) AS a, list_avg(list_transform(x, lambda u: u * u * (u - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5::DOUBLE))) AS b"))
def layernorm_backward(spark, sf_dir):
    d = F.transform("x", lambda v: v * v)
    return _long(_x(spark, sf_dir).withColumn("y", layers.layernorm_backward(d, F.col("x"))), "y", "dx")


@query("A12", _rows("list_transform(x, lambda v: v * r)", "out", ", 1 / sqrt(list_avg(list_transform(x, lambda v: v * v)) + 1e-5::DOUBLE) AS r"))
def rmsnorm_rows(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", layers.rmsnorm(F.col("x"))), "y", "out")


_T = "tanh(0.7978845608028654::DOUBLE * (v + 0.044715::DOUBLE * v * v * v))"


@query("E15 L05", _rows(f"list_transform(x, lambda v: 0.5::DOUBLE * v * (1 + {_T}))", "out"))
def gelu_forward(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", F.transform("x", layers.gelu)), "y", "out")


@query("E15", _rows(f"list_transform(x, lambda v: 0.5::DOUBLE * (1 + {_T}) + 0.5::DOUBLE * v * (1 - {_T} * {_T}) * 0.7978845608028654::DOUBLE * (1 + 3 * 0.044715::DOUBLE * v * v))", "slope"))
def gelu_backward(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", F.transform("x", layers.gelu_slope)), "y", "slope")


@query("E16 E14", _rows("list_transform(x, lambda v: v * (v + 1) / (1 + exp(-(v + 1))) + v)", "out"))
def swiglu_residual(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", F.transform("x", lambda v: layers.swiglu(v, v + 1) + v)), "y", "out")


_LL = f"(SELECT vec_id, label, CAST(i AS BIGINT) AS i, v FROM (SELECT vec_id, label, unnest(x) AS v, unnest(range(0, 64)) AS i FROM {X}))"
_PL = f"(SELECT vec_id, label, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM {_LL}))"


@query("W01", f"SELECT vec_id, i AS c, round(p, 6) AS p FROM {_PL}")
def softmax_rows(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", layers.softmax(F.col("x"))), "y", "p")


@query("W02 ST3 UX3", "SELECT vec_id, round(list_max(x), 6) AS m, round(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS s FROM " + X)
def online_softmax(spark, sf_dir):
    z = layers.online_softmax_state(F.col("x"))
    return _x(spark, sf_dir).select("vec_id", F.round(z["m"], 6).alias("m"), F.round(z["s"], 6).alias("s"))


@query("J05 L08 A15", f"SELECT label, count(*) AS n, round(avg(-ln(p)), 6) AS loss FROM {_PL} WHERE i = label GROUP BY label")
def crossentropy(spark, sf_dir):
    loss = layers.cross_entropy(layers.softmax(F.col("x")), F.col("label"))
    return _x(spark, sf_dir).withColumn("loss", loss).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss")).withColumn("label", F.col("label").cast("int"))


@query("L08 L12", f"SELECT vec_id, i AS c, round((p - CASE WHEN i = label THEN 1 ELSE 0 END) * 0.125::DOUBLE, 6) AS g FROM {_PL}")
def ce_softmax_gradient(spark, sf_dir):
    p = _x(spark, sf_dir).withColumn("p", layers.softmax(F.col("x")))
    return _long(p.withColumn("y", layers.cross_entropy_softmax_gradient(F.col("p"), F.col("label"), 0.125)), "y", "g")


_W = "((o * 7 + i * 3) % 11 - 5) / 8.0"


@query("J06 L03", f"SELECT vec_id, o, round(0.1::DOUBLE * o + sum(v * CAST({_W} AS DOUBLE)), 6) AS out FROM (SELECT vec_id, unnest(x) AS v, unnest(range(0, 64)) AS i FROM {X}), (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS o) GROUP BY vec_id, o")
def linear_forward(spark, sf_dir):
    w = F.array(*[F.array(*[F.lit(((o * 7 + i * 3) % 11 - 5) / 8.0) for i in range(64)]) for o in range(8)])
    b = F.array(*[F.lit(0.1 * o) for o in range(8)])
    y = _x(spark, sf_dir).withColumn("y", layers.linear(F.col("x"), w, b))
    return y.select("vec_id", F.posexplode("y").alias("o", "out")).select("vec_id", F.col("o").cast("long").alias("o"), F.round("out", 6).alias("out"))


_XL = f"(SELECT vec_id AS r, unnest(x) AS v, unnest(range(0, 64)) AS i FROM {X})"
_DO = f"(SELECT vec_id AS r, unnest(x) AS g, unnest(range(0, 64)) AS o FROM {X})"


def _xl(spark, sf_dir):
    x = _x(spark, sf_dir)
    long = x.select(F.col("vec_id").alias("r"), F.posexplode("x").alias("i", "v"))
    return long, long.select("r", F.col("i").alias("o"), F.col("v").alias("g"))


@query("J07", f"SELECT d.o::BIGINT AS o, x.i::BIGINT AS i, round(sum(d.g * x.v), 5) AS dw FROM {_DO} d JOIN {_XL} x USING (r) GROUP BY 1, 2")
def linear_backward_weight(spark, sf_dir):
    x, d = _xl(spark, sf_dir)
    w = x.sparkSession.createDataFrame([(0, 0, 0.0)], "o int, i int, w double")
    return layers.linear_backward(x, d, w)[1].select(F.col("o").cast("long").alias("o"), F.col("i").cast("long").alias("i"), F.round("dw", 5).alias("dw"))


@query("J07 L03", f"SELECT r AS vec_id, CAST(i AS BIGINT) AS i, round(sum(g * CAST({_W} AS DOUBLE)), 6) AS dx FROM {_DO}, (SELECT unnest(range(0, 64)) AS i) GROUP BY 1, 2")
def linear_backward_input(spark, sf_dir):
    x, d = _xl(spark, sf_dir)
    ids = spark.range(4096).select((F.col("id") % 64).cast("int").alias("o"), F.floor(F.col("id") / 64).cast("int").alias("i"))
    w = ids.withColumn("w", ((F.col("o") * 7 + F.col("i") * 3) % 11 - 5) / 8.0)
    return layers.linear_backward(x, d, w)[0].select(F.col("r").alias("vec_id"), F.col("i").cast("long").alias("i"), F.round("dx", 6).alias("dx"))


_QKV = f"(SELECT vec_id // 8 AS b, h, vec_id % 8 AS t, x[h * 16 + 1:h * 16 + 16] AS q, x[(h + 1) % 4 * 16 + 1:(h + 1) % 4 * 16 + 16] AS k, x[(h + 2) % 4 * 16 + 1:(h + 2) % 4 * 16 + 16] AS v FROM {X}, (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS h))"


@query("W03", f"WITH q AS {_QKV}, s AS (SELECT a.b, a.h, a.t, c.t AS t2, list_dot_product(a.q, c.k) * 0.25::DOUBLE AS s, c.v FROM q a JOIN q c ON a.b = c.b AND a.h = c.h AND c.t <= a.t), p AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p FROM s WINDOW w AS (PARTITION BY b, h, t)) SELECT b, h, t, CAST(c AS BIGINT) AS c, round(sum(p * v), 6) AS out FROM (SELECT b, h, t, p, unnest(v) AS v, unnest(range(0, 16)) AS c FROM p) GROUP BY 1, 2, 3, 4")
def causal_attention(spark, sf_dir):
    """Four heads over all 64 values of a vector: a head's queries, the next one's as keys, those after it as values."""
    x = _x(spark, sf_dir).withColumn("h", F.explode(F.array(*map(F.lit, range(4)))))
    part = lambda k: F.slice("x", (F.col("h") + k) % 4 * 16 + 1, F.lit(16))
    qkv = x.select(F.floor(F.col("vec_id") / 8).alias("b"), F.col("h").cast("long").alias("h"), (F.col("vec_id") % 8).alias("t"), part(0).alias("q"), part(1).alias("k"), part(2).alias("v"))
    return layers.causal_attention(qkv, 0.25).select("b", "h", "t", F.col("c").cast("long").alias("c"), F.round("out", 6).alias("out"))


@query("L14", _rows("list_transform(range(1, 65), lambda i: x[i] * cos(vec_id / pow(10000.0::DOUBLE, ((i - 1) - (i - 1) % 2) / 64.0::DOUBLE)) + CASE WHEN i % 2 = 1 THEN -x[i + 1] ELSE x[i - 1] END * sin(vec_id / pow(10000.0::DOUBLE, ((i - 1) - (i - 1) % 2) / 64.0::DOUBLE)))", "out"))
def rope_rows(spark, sf_dir):
    return _long(_x(spark, sf_dir).withColumn("y", layers.rope(F.col("x"), F.col("vec_id"))), "y", "out")


@query("J17", "SELECT vec_id, CAST(h AS BIGINT) AS h, label FROM embeddings, (SELECT unnest(range(0, 4)) AS h) WHERE label % 2 = h // 2")
def grouped_query_heads(spark, sf_dir):
    kv = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("label") % 2).cast("long").alias("kv"))
    return layers.repeat_heads(kv, 4, 2).select("vec_id", "h", "label")


_L = f"(SELECT vec_id, CAST(i AS BIGINT) AS i, v FROM (SELECT vec_id, unnest(x) AS v, unnest(range(0, 64)) AS i FROM {X}))"


def _logits(spark, sf_dir):
    return _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("T01 R03", f"SELECT vec_id, i, round(v, 6) AS v FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS r FROM {_L}) WHERE r <= 5")
def topk_logits(spark, sf_dir):
    return sampling.top_k(_logits(spark, sf_dir), "vec_id", "v", 5).withColumn("v", F.round("v", 6))




def _probs(spark, sf_dir):
    return _x(spark, sf_dir).withColumn("p", layers.softmax(F.col("x"))).select("vec_id", F.posexplode("p").alias("i", "p")).withColumn("i", F.col("i").cast("long"))


@query("W10 R03", f"SELECT vec_id, i FROM (SELECT vec_id, i, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM {_PL}) WHERE c <= 0.5")
def topp_nucleus(spark, sf_dir):
    return sampling.top_p(_probs(spark, sf_dir), "vec_id", "i", "p", 0.5).select("vec_id", "i")


@query("W11 R02", f"SELECT vec_id, coalesce(min(CASE WHEN coin < c THEN i END), max(i)) AS pick FROM (SELECT vec_id, i, ((vec_id * 37) % 101) / 101.0::DOUBLE AS coin, sum(p) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {_PL}) GROUP BY vec_id")
def cdf_sample(spark, sf_dir):
    p = _probs(spark, sf_dir)
    coins = p.select("vec_id").distinct().withColumn("coin", ((F.col("vec_id") * 37) % 101) / F.lit(101.0))
    return sampling.sample_cdf(p, coins, "vec_id", "i", "p")


@query("T02", f"SELECT vec_id, min(i) AS pick FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM {_L}) WHERE v = m GROUP BY vec_id")
def greedy_argmax(spark, sf_dir):
    return sampling.greedy(_logits(spark, sf_dir), "vec_id", "i", "v")


@query("O01 O02", f"SELECT vec_id, i, round(v - 0.001::DOUBLE * (((0.9::DOUBLE * 0.01::DOUBLE + (1 - 0.9::DOUBLE) * v * 0.5::DOUBLE) / (1 - pow(0.9::DOUBLE, 3))) / (sqrt((0.999::DOUBLE * 0.02::DOUBLE + (1 - 0.999::DOUBLE) * v * 0.5::DOUBLE * v * 0.5::DOUBLE) / (1 - pow(0.999::DOUBLE, 3))) + 1e-8::DOUBLE) + CASE WHEN i % 16 IN (0, 1, 4, 6, 10, 12) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END * v), 9) AS p FROM {_L}")
def adamw_step(spark, sf_dir):
    v = F.col("v")
    decay = F.when((F.col("i") % 16).isin(*optim.DECAYED), 0.1).otherwise(0.0)
    p = optim.adamw(v, v * 0.5, F.lit(0.01), F.lit(0.02), 3, 0.001, decay=decay)["p"]
    return _logits(spark, sf_dir).select("vec_id", "i", F.round(p, 9).alias("p"))


@query("A16 O03", f"SELECT round(sqrt(sum(v * v)), 5) AS norm, round(least(1, 1 / sqrt(sum(v * v))), 9) AS scale FROM {_L}")
def grad_norm_clip(spark, sf_dir):
    return optim.clip_scale(_logits(spark, sf_dir), "v").select(F.round("norm", 5).alias("norm"), F.round("scale", 9).alias("scale"))


_S = "CASE WHEN s < 100 THEN 0.001::DOUBLE * (s + 1) / 100 {0} END"


@query("O04 UX6", f"SELECT s AS step, round({_S.format('ELSE 0.001::DOUBLE * 0.1 + 0.5 * (1 + cos(pi() * (s - 100) / 900.0::DOUBLE)) * (0.001::DOUBLE - 0.0001::DOUBLE)')}, 10) AS cosine, round({_S.format('ELSE 0.001::DOUBLE - 0.0009::DOUBLE * (s - 100) / 900.0::DOUBLE')}, 10) AS linear, 0.001::DOUBLE AS constant, round({_S.format('WHEN s < 800 THEN 0.001::DOUBLE ELSE 0.0001::DOUBLE + (1 - sqrt((s - 800) / 200.0::DOUBLE)) * 0.0009::DOUBLE')}, 10) AS wsd FROM (SELECT CAST(unnest(range(0, 1000)) AS BIGINT) AS s)")
def lr_schedules(spark, sf_dir):
    s = F.col("id")
    return spark.range(1000).select(s.alias("step"), *[F.round(f(s, 0.001, 100, 1000, 0.1), 10).alias(k) for k, f in optim.SCHEDULES.items()])


@query("O08", "SELECT depth, 6 * n + 6 * depth * c * 1024 AS flops FROM (SELECT depth, c, 12 * depth * c * c + 50304 * c AS n FROM (VALUES (12::BIGINT, 768::BIGINT), (24, 1024), (36, 1280), (48, 1600)) t(depth, c))")
def model_flops(spark, sf_dir):
    m = spark.createDataFrame([(12, 768), (24, 1024), (36, 1280), (48, 1600)], "depth long, c long")
    d, c = F.col("depth"), F.col("c")
    return m.select("depth", optim.flops_per_token(12 * d * c * c + 50304 * c, d, c, F.lit(1024)).cast("long").alias("flops"))


@query("O06", f"SELECT i, round(sum(v) / count(DISTINCT vec_id // 100), 6) AS g FROM {_L} GROUP BY i")
def gradient_accumulation(spark, sf_dir):
    micro = _logits(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 100).alias("micro"), "i").agg(F.sum("v").alias("g"))
    return micro.groupBy("i").agg(F.round(F.sum("g") / F.count(F.lit(1)), 6).alias("g"))


@query("X05", f"SELECT i // 16 AS shard, i // 16 * 16 AS first, count(*) AS n, round(sum(g * (i + 1)), 5) AS g FROM (SELECT i, sum(v) / count(DISTINCT vec_id % 4) AS g FROM {_L} GROUP BY i) GROUP BY 1, 2")
def optimizer_shards(spark, sf_dir):
    """Gradients of four ranks, each value's mean at the rank that updates its shard."""
    g = _logits(spark, sf_dir).select((F.col("vec_id") % 4).alias("rank"), "i", F.col("v").alias("g"))
    s = optim.reduce_scatter(g, optim.shard_size(64, 4))
    return s.groupBy("shard", "first").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("g") * (F.col("i") + 1)), 5).alias("g"))
