"""Queries of loader state, sampling and noise, layers' backward passes, and optimiser state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers, loader, optim, sampling, train
from ..operators.checkpoints import CheckpointSets
from ..operators.checkpoints import train as train_in_sets
from ..session import scratch, stored, table
from .catalog import query
from .tensors import _LL, X, _x

B, T, RANKS, SHARDS, TOKENS = 4, 8, 2, 4, 140
EACH = (TOKENS - 1) // (B * T * RANKS)


@query("P05 P14 ST4 X03", f"""SELECT CAST(s // {EACH * SHARDS} AS BIGINT) AS epoch, CAST(s // {EACH} % {SHARDS} AS BIGINT) AS shard, CAST(s % {EACH} AS BIGINT) AS sample, CAST(r AS BIGINT) AS rank, CAST(b AS BIGINT) AS row, CAST(t AS BIGINT) AS t,
  CAST(s // {EACH} % {SHARDS} * {TOKENS} + s % {EACH} * {B * T * RANKS} + r * {B * T} + b * {T} + t AS BIGINT) AS input, CAST(s // {EACH} % {SHARDS} * {TOKENS} + s % {EACH} * {B * T * RANKS} + r * {B * T} + b * {T} + t + 1 AS BIGINT) AS target
FROM (SELECT unnest(range(5, {3 * EACH * SHARDS})) AS s), (SELECT unnest(range(0, {RANKS})) AS r), (SELECT unnest(range(0, {B})) AS b), (SELECT unnest(range(0, {T})) AS t)""")
def loader_epochs(spark, sf_dir):
    """Batches of four shards of 140 consecutive tokens over three epochs, resumed at step 5."""
    tokens = spark.range(SHARDS * TOKENS).select(F.floor(F.col("id") / TOKENS).alias("shard"), (F.col("id") % TOKENS).alias("pos"), F.col("id").alias("tok"))
    cursor = loader.cursor(spark, [TOKENS] * SHARDS, B, T, RANKS, first=5, steps=3 * EACH * SHARDS - 5)
    return loader.batches(tokens, cursor, B, T, RANKS).drop("step")


@query("P06")
def permuted_shards(spark, sf_dir):
    """Shuffled order of shards and of their samples by the generator that each epoch seeds."""
    return loader.permuted(spark, shards=6, samples=5, epochs=3, seed=42)


@query("P07 O10")
def random_normals(spark, sf_dir):
    """Seeded uniform and normal numbers, sixteen lanes at a time."""
    return sampling.normals(spark, seeds=range(1, 9), n=50)


@query("P08", "WITH e AS (SELECT doc_id AS idx, row_number() OVER (ORDER BY doc_id) - 1 AS k, 3 + doc_id % 5 AS ctx FROM labels) SELECT idx, CAST(k // 2 AS BIGINT) AS batch, CAST(k % 2 * 4 + c AS BIGINT) AS row, CAST(t AS BIGINT) AS t, t >= ctx - 1 AND t < ctx - 1 + 1 + (idx + c) % 4 AS mask FROM e, (SELECT unnest(range(0, 4)) AS c), (SELECT unnest(range(0, 12)) AS t) WHERE t < ctx + 1 + (idx + c) % 4")
def evaluation_batches(spark, sf_dir):
    """Two examples of four completions a batch of eight rows; the mask marks where a completion's tokens are targets."""
    x = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), (3 + F.col("doc_id") % 5).alias("ctx"))
    lengths = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: 1 + (F.col("idx") + c) % 4)
    return loader.evaluation_rows(x.withColumn("endings", lengths), rows=8)


@query("P09", "SELECT idx, rank FROM (SELECT doc_id AS idx, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 7.0)) AS BIGINT) AS rank FROM labels)")
def ceil_split(spark, sf_dir):
    """Rows in order to seven ranks, ceil(n / 7) each, the last ones cropped."""
    return loader.split(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx")), "idx", 7)


def _u32(x: str) -> str:
    return f"(({x}) & 4294967295)"


_SQ = [f"SELECT l_orderkey, l_linenumber, {_u32('(l_orderkey::HUGEINT * ' + str(sampling.NOISE[0]) + ' % 4294967296)::BIGINT + l_linenumber')} AS m FROM lineitem"]
for _step in (f"xor(m, m >> 9) + {sampling.NOISE[1]}", f"xor(m, m >> 11) * {sampling.NOISE[2]}", f"xor(m, m >> 13) + {sampling.NOISE[3]}", f"xor(m, m >> 15) * {sampling.NOISE[4]}"):
    _SQ.append(f"SELECT l_orderkey, l_linenumber, CAST({_step.replace('* ', '::HUGEINT * ') if '*' in _step else _step} AS HUGEINT) % 4294967296 AS m FROM (SELECT l_orderkey, l_linenumber, CAST(m AS BIGINT) AS m FROM ({_SQ[-1]}))")


@query("R05", f"SELECT l_orderkey, l_linenumber, CAST(xor(m, m >> 17) AS BIGINT) AS noise FROM (SELECT l_orderkey, l_linenumber, CAST(m AS BIGINT) AS m FROM ({_SQ[-1]}))")
def position_noise(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sampling.noise(F.col("l_orderkey"), F.col("l_linenumber").cast("long")).alias("noise"))


@query("R03 R04", f"WITH p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, i, exp((v - max(v) OVER (PARTITION BY vec_id)) / 0.5::DOUBLE) AS e FROM {_LL})) SELECT vec_id, i, round(p, 6) AS p FROM p")
def temperature_softmax(spark, sf_dir):
    p = _x(spark, sf_dir).select("vec_id", F.posexplode(sampling.tempered(F.col("x"), 0.5)).alias("i", "p"))
    return p.select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"))


@query("R04", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS k FROM conversations), t AS (SELECT conv_id, turn, k, CAST(length(w) AS BIGINT) AS tok FROM w), s AS (SELECT conv_id, turn, min(CASE WHEN tok IN (7, 9) AND k >= 3 THEN k END) AS stop FROM t WHERE k < 16 GROUP BY 1, 2) SELECT conv_id, turn, count(*) FILTER (k >= 3 AND k < 16 AND (stop IS NULL OR k < stop)) AS made, CAST(coalesce(sum(tok) FILTER (k < 16 AND (stop IS NULL OR k < stop)), 0) AS BIGINT) AS echoed FROM t JOIN s USING (conv_id, turn) GROUP BY 1, 2")
def stopped_generation(spark, sf_dir):
    """Three prompt tokens, then at most 13 more, up to the first stop token; without the prompt and with it."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w).cast("long")).alias("tok"))
    kept = sampling.until_stop(F.col("tok"), 3, 13, (7, 9))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return t.select("conv_id", "turn", F.greatest(F.size(kept) - 3, F.lit(0)).cast("long").alias("made"), total(kept).alias("echoed"))


@query("E18", "SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) + l_extendedprice * l_discount, 6) AS v FROM lineitem")
def linear_interpolation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(layers.lerp(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")), 6).alias("v"))


# (B, N, 3, NH, d) to (3, B, NH, N, d): vectors of 64 as 2 x 4 x 8 of which six groups of eight are q, k, v of two heads
@query("E19", f"SELECT CAST(i // 16 AS BIGINT) AS part, vec_id // 8 AS b, CAST(i // 8 % 2 AS BIGINT) AS h, vec_id % 8 AS n, CAST(i % 8 AS BIGINT) AS d, round(v, 6) AS v FROM {_LL} WHERE i < 48")
def permuted_heads(spark, sf_dir):
    x = _x(spark, sf_dir).select((F.floor(F.col("vec_id") / 8)).alias("b"), (F.col("vec_id") % 8).alias("n"), F.slice("x", 1, 48).alias("x"))
    return layers.permute(x, 2, 8).withColumn("v", F.round("v", 6))


@query("E19", f"SELECT vec_id, round(sum(v * i), 4) AS check FROM {_LL} WHERE i < 48 GROUP BY vec_id")
def permuted_back(spark, sf_dir):
    x = _x(spark, sf_dir).select((F.floor(F.col("vec_id") / 8)).alias("b"), (F.col("vec_id") % 8).alias("n"), F.slice("x", 1, 48).alias("x"))
    back = layers.unpermute(layers.permute(x, 2, 8), 2, 8)
    return back.select((F.col("b") * 8 + F.col("n")).alias("vec_id"), F.round(layers.total(F.transform("x", lambda v, i: v * i)), 4).alias("check"))


@query("L07", f"SELECT vec_id, CAST(i AS BIGINT) AS c, round(CASE WHEN i < 50 THEN e / s ELSE 0 END, 6) AS p FROM (SELECT *, sum(e) FILTER (i < 50) OVER (PARTITION BY vec_id) AS s FROM (SELECT vec_id, i, exp(v) AS e FROM {_LL}))")
def padded_softmax(spark, sf_dir):
    p = _x(spark, sf_dir).select("vec_id", F.posexplode(layers.padded_softmax(F.col("x"), 50)).alias("c", "p"))
    return p.select("vec_id", F.col("c").cast("long").alias("c"), F.round("p", 6).alias("p"))


_RL = f"(SELECT vec_id, list_transform(x, lambda v: v + v * v) AS r FROM {X})"


@query("L13", f"SELECT vec_id, CAST(c - 1 AS BIGINT) AS c, round(r, 6) AS residual, round(v, 6) AS out FROM (SELECT vec_id, unnest(r) AS r, unnest(list_transform(r, lambda v: (v - m) * s)) AS v, unnest(range(1, 65)) AS c FROM (SELECT *, list_avg(r) AS m, 1 / sqrt(list_var_pop(r) + 1e-5::DOUBLE) AS s FROM {_RL}))")
def residual_layernorm(spark, sf_dir):
    """The residual sum and its normalisation in one projection."""
    y = _x(spark, sf_dir).withColumn("y", layers.residual_layernorm(F.col("x"), F.transform("x", lambda v: v * v)))
    flat = y.select("vec_id", F.posexplode(F.arrays_zip("y.residual", "y.out")).alias("c", "z"))
    return flat.select("vec_id", F.col("c").cast("long").alias("c"), F.round("z.residual", 6).alias("residual"), F.round("z.out", 6).alias("out"))


_F = "pow(500000.0::DOUBLE, -(2 * k) / 64.0::DOUBLE)"


@query("L14", f"WITH f AS (SELECT CAST(k AS BIGINT) AS k, {_F} AS f FROM (SELECT unnest(range(0, 32)) AS k)), w AS (SELECT *, 2 * pi() / f AS w FROM f) SELECT k, round(CASE WHEN w < 2048 THEN f WHEN w > 8192 THEN f / 8 ELSE (1 - (8192 / w - 1) / 3) * f / 8 + (8192 / w - 1) / 3 * f END * 1000, 9) AS milli FROM w")
def scaled_frequencies(spark, sf_dir):
    f = F.pow(F.lit(500000.0), -(2 * F.col("id")) / F.lit(64.0))
    return spark.range(32).select(F.col("id").alias("k"), F.round(layers.stretched(f) * 1000, 9).alias("milli"))


def _heads(spark, sf_dir):
    x = _x(spark, sf_dir).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    part = lambda k: F.slice("x", F.col("h") * 32 + k, F.lit(8))
    return x.select(F.floor(F.col("vec_id") / 8).alias("b"), F.col("h").cast("long").alias("h"), (F.col("vec_id") % 8).alias("t"), part(1).alias("q"), part(9).alias("k"), part(17).alias("v"), part(25).alias("dout"))


_H = f"(SELECT vec_id // 8 AS b, h, vec_id % 8 AS t, x[h * 32 + 1:h * 32 + 8] AS q, x[h * 32 + 9:h * 32 + 16] AS k, x[h * 32 + 17:h * 32 + 24] AS v, x[h * 32 + 25:h * 32 + 32] AS g FROM {X}, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS h))"
_S = f"""WITH q AS {_H}, s AS (SELECT a.b, a.h, a.t, c.t AS t2, exp(list_dot_product(a.q, c.k) * 0.5::DOUBLE) AS e, list_dot_product(a.g, c.v) AS dp, a.q, c.k, a.g FROM q a JOIN q c ON a.b = c.b AND a.h = c.h AND c.t <= a.t),
  p AS (SELECT *, e / sum(e) OVER (PARTITION BY b, h, t) AS p FROM s), d AS (SELECT *, p * (dp - sum(p * dp) OVER (PARTITION BY b, h, t)) * 0.5::DOUBLE AS ds FROM p),
  u AS (SELECT b, h, t, t2, p, ds, unnest(q) AS q, unnest(k) AS k, unnest(g) AS g, unnest(range(0, 8)) AS c FROM d)"""


@query("L04 J08", f"{_S} SELECT b, h, t, CAST(c AS BIGINT) AS c, round(sum(ds * k), 6) + 0.0 AS dq FROM u GROUP BY 1, 2, 3, 4")
def attention_backward_q(spark, sf_dir):
    return _rounded(layers.attention_backward(_heads(spark, sf_dir), 0.5)[0], "dq")


@query("L04 J08 J09", f"{_S} SELECT b, h, t2 AS t, CAST(c AS BIGINT) AS c, round(sum(ds * q), 6) + 0.0 AS dk, round(sum(p * g), 6) + 0.0 AS dv FROM u GROUP BY 1, 2, 3, 4")
def attention_backward_kv(spark, sf_dir):
    return _rounded(layers.attention_backward(_heads(spark, sf_dir), 0.5)[1], "dk", "dv")


def _rounded(df, *names):
    return df.select("b", "h", "t", F.col("c").cast("long").alias("c"), *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names])


@query("ST7 L15", f"WITH q AS {_H}, s AS (SELECT a.b, a.h, exp(list_dot_product(a.q, c.k) * 0.5::DOUBLE) AS e, c.v FROM q a JOIN q c ON a.b = c.b AND a.h = c.h WHERE a.t = (SELECT max(t) FROM q z WHERE z.b = a.b)), u AS (SELECT b, h, e, unnest(v) AS v, unnest(range(0, 8)) AS c FROM s) SELECT b, h, CAST(c AS BIGINT) AS c, round(sum(e * v) / sum(e), 6) + 0.0 AS out FROM u GROUP BY 1, 2, 3")
def cached_attention(spark, sf_dir):
    """The last position's output from the keys and values that earlier steps left in the cache."""
    x = _heads(spark, sf_dir)
    last = x.groupBy("b", "h").agg(F.max_by("q", "t").alias("q"))
    return _cached(layers.cached_attention(last, stored(x.select("b", "h", "t", "k", "v"), "kv-cache"), 0.5))


def _cached(df):
    return df.select("b", "h", F.col("c").cast("long").alias("c"), (F.round("out", 6) + F.lit(0.0)).alias("out"))


_TOK = "SELECT conv_id, turn, CAST(length(unnest(string_split(text, ' '))) AS BIGINT) AS tok, unnest(range(0, len(string_split(text, ' ')))) AS t FROM conversations"


def _positions(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("t", "w"))
    return w.select(F.length("w").cast("long").alias("tok"), F.col("t").cast("long").alias("t"), (F.col("t") * 0.125 + F.col("conv_id") % 5).alias("g"))


@query("A13 L01", f"SELECT tok, round(sum(t * 0.125::DOUBLE + conv_id % 5), 4) AS dwte FROM ({_TOK}) GROUP BY tok")
def embedding_backward_token(spark, sf_dir):
    return layers.scatter_add(_positions(spark, sf_dir), "tok", "g").select("tok", F.round("g", 4).alias("dwte"))


@query("A13 L01", f"SELECT CAST(t AS BIGINT) AS t, round(sum(t * 0.125::DOUBLE + conv_id % 5), 4) AS dwpe FROM ({_TOK}) GROUP BY t")
def embedding_backward_position(spark, sf_dir):
    return layers.scatter_add(_positions(spark, sf_dir), "t", "g").select("t", F.round("g", 4).alias("dwpe"))


@query("A29 L03", f"SELECT i AS o, round(sum(v), 5) AS db FROM {_LL} GROUP BY i")
def bias_gradient(spark, sf_dir):
    d = _x(spark, sf_dir).select(F.posexplode("x").alias("o", "g"))
    return layers.scatter_add(d, "o", "g").select(F.col("o").cast("long").alias("o"), F.round("g", 5).alias("db"))


@query("J09", f"WITH a AS (SELECT vec_id // 8 AS b, vec_id % 8 AS t, x FROM {X}) SELECT l.b, l.t, r.t AS t2, round(list_dot_product(l.x, r.x), 6) AS s FROM a l JOIN a r ON l.b = r.b AND r.t <= l.t")
def triangular_product(spark, sf_dir):
    a = _x(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("b"), (F.col("vec_id") % 8).alias("t"), "x")
    return layers.triangular(a).withColumn("s", F.round("s", 6))


@query("O05", "SELECT event_id, abs(round(z, 6)) > 3 AS skipped FROM (SELECT event_id, CASE WHEN k > 128 THEN CASE WHEN d = 0 THEN 0 ELSE (value - m) / d END END AS z FROM (SELECT event_id, value, avg(value) OVER f AS m, stddev_pop(value) OVER f AS d, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WINDOW f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW))) WHERE z IS NOT NULL")
def skipped_updates(spark, sf_dir):
    """Steps whose loss is too far from the last ones make no update."""
    from ..operators import telemetry

    z = telemetry.sliding_zscore(table(spark, sf_dir, "events"), "value", ["event_id"], ["event_type"])
    return z.where("z is not null").select("event_id", optim.skip(F.round("z", 6), 3.0).alias("skipped"))


@query("O06 A15", f"WITH m AS (SELECT vec_id, vec_id // 50 AS step, vec_id // 10 % 5 AS micro, i, v FROM {_LL}) SELECT step, i, round(sum(v) / (10 * 5), 6) AS g, round(max(l), 6) AS loss FROM m JOIN (SELECT vec_id // 50 AS step, sum(list_sum(list_transform(x, lambda v: v * v))) / 2 / (10 * 5) AS l FROM {X} GROUP BY 1) USING (step) GROUP BY 1, 2")
def micro_steps(spark, sf_dir):
    """Gradients of five micro-batches of ten rows a step, scaled as they are made and zeroed at each step's first; the mean loss, of which a
    vector is the gradient: half of its square."""
    x = _x(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).alias("step"), (F.floor(F.col("vec_id") / 10) % 5).alias("micro"), "x")
    g = optim.accumulated(x.select("step", "micro", F.posexplode("x").alias("i", "g")), rows=10, micro_steps=5)
    loss = x.groupBy("step").agg((F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)) / 2 / 50).alias("loss"))
    return g.join(loss, "step").select("step", F.col("i").cast("long").alias("i"), F.round("g", 6).alias("g"), F.round("loss", 6).alias("loss"))


@query("O07", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {round(optim.promised(n, 'bf16'), 4)}::DOUBLE)" for n in ("NVIDIA A100-SXM4-80GB", "NVIDIA H100 80GB HBM3")) + ") t(device, tflops)")
def promised_flops(spark, sf_dir):
    return optim.promised_table(spark, "bf16").where(F.col("device").isin("NVIDIA A100-SXM4-80GB", "NVIDIA H100 80GB HBM3")).withColumn("tflops", F.round("tflops", 4))


@query("ST6 K10 O01", f"""WITH RECURSIVE s AS (SELECT vec_id, i, 0 AS step, v AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS n FROM {_LL}
  UNION ALL SELECT vec_id, i, step + 1, p - 0.01::DOUBLE * ((0.9::DOUBLE * m + 0.1::DOUBLE * p) / (1 - pow(0.9::DOUBLE, step + 1)) / (sqrt((0.999::DOUBLE * n + 0.001::DOUBLE * p * p) / (1 - pow(0.999::DOUBLE, step + 1))) + 1e-8::DOUBLE)), 0.9::DOUBLE * m + 0.1::DOUBLE * p, 0.999::DOUBLE * n + 0.001::DOUBLE * p * p FROM s WHERE step < 3)
SELECT vec_id, i, round(p, 7) AS p, round(m, 7) AS m, round(n, 7) AS v FROM s WHERE step = 3""")
def optimizer_state(spark, sf_dir):
    """Three optimiser steps on gradient p, parameters and moments written and read between them."""
    x = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), "p", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    for step in (1, 2, 3):
        new = optim.adamw(F.col("p"), F.col("p"), F.col("m"), F.col("v"), step, 0.01)
        x = stored(x.select("vec_id", "i", *[c.alias(k) for k, c in new.items()]), "optimizer-state")
    return x.select("vec_id", "i", *[F.round(c, 7).alias(c) for c in ("p", "m", "v")])


_K11_STEPS = 6


@query("K11 K10", f"""WITH RECURSIVE s AS (SELECT vec_id, i, 0 AS step, v AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS n FROM {_LL}
  UNION ALL SELECT vec_id, i, step + 1, p - 0.01::DOUBLE * ((0.9::DOUBLE * m + 0.1::DOUBLE * p) / (1 - pow(0.9::DOUBLE, step + 1)) / (sqrt((0.999::DOUBLE * n + 0.001::DOUBLE * p * p) / (1 - pow(0.999::DOUBLE, step + 1))) + 1e-8::DOUBLE)), 0.9::DOUBLE * m + 0.1::DOUBLE * p, 0.999::DOUBLE * n + 0.001::DOUBLE * p * p FROM s WHERE step < {_K11_STEPS})
SELECT vec_id, i, round(p, 6) AS p, '2:false,4:true,6:true' AS sets FROM s WHERE step = {_K11_STEPS}""")
def resumed_training(spark, sf_dir):
    """Six optimiser steps with a checkpoint set after every second one: the run dies while the set of step 4 has no marker
    yet and a second run goes on from step 2. Two sets stay; `sets` tells which of those written are there."""
    x = _x(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), "p", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))

    def step(n, tables):
        new = optim.adamw(F.col("p"), F.col("p"), F.col("m"), F.col("v"), n, 0.01)
        return {"parameters": tables["parameters"].select("vec_id", "i", *[c.alias(k) for k, c in new.items()])}

    sets = CheckpointSets(spark, scratch(spark, "sets"))
    train_in_sets(sets, lambda: {"parameters": x}, step, _K11_STEPS, every=2, last=2, dies_at=4)
    out = train_in_sets(sets, lambda: {"parameters": x}, step, _K11_STEPS, every=2, last=2)["parameters"]
    there = sets.steps()
    told = ",".join(f"{n}:{str(there.get(n, False)).lower()}" for n in (2, 4, 6))
    return out.select("vec_id", "i", F.round("p", 6).alias("p"), F.lit(told).alias("sets"))


@query("K11", "WITH f AS (SELECT DISTINCT event_id % 40 * 100 AS step, event_type AS kind FROM events WHERE NOT (event_id % 40 > 30 AND event_type = 'click')), s AS (SELECT step, count(*) AS files, bool_or(kind = 'click') AS done FROM f GROUP BY step), d AS (SELECT *, row_number() OVER (ORDER BY step DESC) AS r FROM s WHERE done) SELECT CAST(step AS BIGINT) AS step, s.done, coalesce(d.r = 1, false) AS resume, s.done AND (d.r <= 3 OR step % 1000 = 0) AS keep FROM s LEFT JOIN d USING (step)")
def checkpoint_set(spark, sf_dir):
    """Checkpoints as files of steps: complete where the marker is there, the last complete one is resumed from, three and every thousandth stay."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 40 * 100).alias("step"), F.col("event_type").alias("kind")).where("not (step > 3000 and kind = 'click')").distinct()
    return optim.retained(e, marker="click", last=3, every=1000)


@query("O10", "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate("wte wpe ln1w ln1b qkvw qkvb attprojw attprojb ln2w ln2b fcw fcb fcprojw fcprojb lnfw lnfb".split())) + ") t(k, tensor)), l AS (SELECT * FROM (VALUES (12::BIGINT), (24), (36), (48)) t(layers)) SELECT layers, tensor, CASE WHEN tensor IN ('ln1w', 'ln2w', 'lnfw') THEN 1.0::DOUBLE ELSE 0.0 END AS mean, round(CASE WHEN tensor IN ('attprojw', 'fcprojw') THEN 0.02::DOUBLE / sqrt(2 * layers) WHEN tensor IN ('wte', 'wpe', 'qkvw', 'fcw') THEN 0.02::DOUBLE ELSE 0 END, 9) AS spread FROM s, l")
def initial_weights(spark, sf_dir):
    return optim.initial(spark, [12, 24, 36, 48]).withColumn("spread", F.round("spread", 9))


@query("K15", f"SELECT CAST(i AS BIGINT) AS row, vec_id AS col, round(v, 6) AS v FROM {_LL}")
def exported_weights(spark, sf_dir):
    """Weights transposed for the export, as rows."""
    x = _x(spark, sf_dir).select(F.col("vec_id").alias("row"), F.posexplode("x").alias("col", "v"))
    return optim.transposed(x).select(F.col("row").cast("long").alias("row"), "col", F.round("v", 6).alias("v"))


@query("X04", f"SELECT i // 8 AS block, round(avg(v), 6) AS mean, count(DISTINCT vec_id % 4) AS ranks FROM {_LL} GROUP BY 1")
def reduced_blocks(spark, sf_dir):
    x = _x(spark, sf_dir).select((F.col("vec_id") % 4).alias("rank"), F.posexplode("x").alias("i", "g"))
    return optim.reduce_blocks(x, 8).withColumn("mean", F.round("mean", 6))


@query("A05", f"WITH a AS (SELECT vec_id AS i, i AS j, v FROM {_LL}) SELECT round(max(abs(l.v - r.v)), 6) AS diff FROM a l JOIN a r ON l.i = r.j AND l.j = r.i WHERE l.j <= l.i")
def lower_triangle_diff(spark, sf_dir):
    """Largest difference between a matrix and its transpose on and below the diagonal."""
    a = _x(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode("x").alias("j", "v"))
    return optim.lower_difference(a, optim.transposed(a.toDF("row", "col", "v")).toDF("i", "j", "v")).select(F.round("diff", 6).alias("diff"))


@query("A27", "SELECT l.event_type AS v, l.n AS first, r.n AS second FROM (SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1) l FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1) r USING (event_type) WHERE l.n IS DISTINCT FROM r.n")
def multiset_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return loader.multiset_difference(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), "event_type")


@query("A30", "SELECT user_id % 4 AS rank, round(avg(l), 6) AS loss FROM (SELECT user_id, event_id // 100 AS batch, avg(value) AS l FROM events GROUP BY user_id, event_id // 100) GROUP BY 1")
def validation_loss(spark, sf_dir):
    """Mean loss over the batches of each rank."""
    e = table(spark, sf_dir, "events")
    batch = e.groupBy("user_id", F.floor(F.col("event_id") / 100).alias("batch")).agg(F.avg("value").alias("l"))
    return batch.groupBy((F.col("user_id") % 4).alias("rank")).agg(F.round(F.avg("l"), 6).alias("loss"))


@query("A28", "SELECT o_custkey AS row, count(*) AS nnz, count(*) FILTER (o_orderkey % 97 = 0) AS zeros FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 97 = 0) > 0")
def zero_entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row"), (F.col("o_orderkey") % 97).alias("v"))
    return o.groupBy("row").agg(F.count(F.lit(1)).alias("nnz"), F.count(F.when(F.col("v") == 0, 1)).alias("zeros")).where("zeros > 0")


@query("L09 I10 A16")
def training_losses(spark, sf_dir):
    """Ten optimiser steps of a tiny language model on a table's words: gradients of a block of rows each, summed."""
    return train.losses(train.batches_of(table(spark, sf_dir, "conversations"), "text", train.TINY), train.TINY, steps=10)


@query("I11 R02 R04")
def generated_tokens(spark, sf_dir):
    """Tokens that the untrained tiny model makes, greedily, from prompts of each conversation's first words."""
    return train.generated(train.batches_of(table(spark, sf_dir, "conversations"), "text", train.TINY), train.TINY, prompt=3, most=6)


