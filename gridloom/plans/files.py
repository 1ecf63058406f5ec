"""Queries of binary files whose values come from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers
from ..operators.ordering import accumulated
from ..session import scratch, stored, table
from ..sources import binary_files, sections
from .catalog import query
from .tensors import X, _x

#: A small model's shape; its context is as long as the table asks for.
C, LAYERS, VOCAB, PADDED, HEADS = 16, 2, 61, 64, 2
SIZES = binary_files.tensor_sizes(0, PADDED, LAYERS, C)
REST = sum(SIZES.values())


def _numbered(spark, sf_dir):
    """(k, x): the rows of embeddings in order, stored."""
    return stored(accumulated(_x(spark, sf_dir), ["vec_id"]).select(F.col("_k").alias("k"), "label", "x"), "rows")


def _flat(rows, column: str):
    return rows.select((F.col("k") * 64).alias("idx"), F.col(column).cast("array<double>").alias("val"))


def _told(df, name: str = "section"):
    """Per section its values, their sum, and a sum that depends on their places."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 2).alias("sum"), F.round(F.sum(F.col("val") * (F.col("idx") % 97)), 1).alias("place"))


K = f"SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM {X}"
TOLD = "SELECT section, count(*) AS n, round(sum(val::FLOAT::DOUBLE), 2) AS sum, round(sum(val::FLOAT::DOUBLE * (idx % 97)), 1) AS place FROM f GROUP BY section"


@query("S29 K16", f"""WITH r AS (SELECT k, x, list_avg(x) AS mean, 1 / sqrt(list_var_pop(x) + 1e-5::DOUBLE) AS rstd FROM ({K})),
e AS (SELECT k * 64 + i - 1 AS idx, k, i - 1 AS c, x[i] AS x, (x[i] - mean) * rstd AS norm, mean, rstd FROM r, (SELECT unnest(range(1, 65)) AS i)),
g AS (SELECT *, x * (1 + c / 64.0::DOUBLE) AS dnorm FROM e), h AS (SELECT *, avg(dnorm) OVER (PARTITION BY k) AS a, avg(dnorm * norm) OVER (PARTITION BY k) AS b FROM g),
f AS (SELECT 'x' AS section, idx, x AS val FROM e UNION ALL SELECT 'w', c, 1 + c / 64.0::DOUBLE FROM (SELECT unnest(range(0, 64)) AS c) UNION ALL SELECT 'b', c, c / 128.0::DOUBLE FROM (SELECT unnest(range(0, 64)) AS c)
  UNION ALL SELECT 'out', idx, norm * (1 + c / 64.0::DOUBLE) + c / 128.0::DOUBLE FROM e UNION ALL SELECT 'mean', k, mean FROM r UNION ALL SELECT 'rstd', k, rstd FROM r UNION ALL SELECT 'dout', idx, x FROM e
  UNION ALL SELECT 'dx', idx, (dnorm - a - norm * b) * rstd FROM h UNION ALL SELECT 'dw', c, sum(x * norm) FROM e GROUP BY c UNION ALL SELECT 'db', c, sum(x) FROM e GROUP BY c)
{TOLD}""")
def layernorm_fixture(spark, sf_dir):
    """A layer's inputs, results and gradients over all embeddings as one file of sections, read back by ranges."""
    r = _numbered(spark, sf_dir)
    n = layers.layernorm(F.col("x"))
    r = stored(r.select("k", "x", n["mean"].alias("mean"), n["rstd"].alias("rstd"), F.transform("x", lambda v: (v - n["mean"]) * n["rstd"]).alias("norm")), "normed")
    weighted = F.transform("norm", lambda v, i: v * (1 + i / 64) + i / 128)
    dnorm = F.transform("x", lambda v, i: v * (1 + i / 64))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / 64
    a, b = mean(dnorm), mean(F.zip_with(dnorm, "norm", lambda d, v: d * v))
    d = r.withColumn("d", dnorm).withColumn("a", a).withColumn("b", b)
    dx = F.transform(F.zip_with("d", "norm", lambda g, v: F.struct(g.alias("g"), v.alias("v"))), lambda e: (e["g"] - F.col("a") - e["v"] * F.col("b")) * F.col("rstd"))
    by_column = r.select(F.posexplode(F.zip_with("x", "norm", lambda g, v: F.struct(g.alias("g"), v.alias("v")))).alias("idx", "e")).groupBy("idx").agg(F.sum(F.col("e.g") * F.col("e.v")).alias("dw"), F.sum("e.g").alias("db"))
    c = spark.range(64).withColumnRenamed("id", "idx")
    parts = {"x": _flat(r, "x"), "dout": _flat(r, "x"), "out": _flat(r.withColumn("y", weighted), "y"), "dx": _flat(d.withColumn("y", dx), "y"), "mean": r.select(F.col("k").alias("idx"), F.col("mean").alias("val")), "rstd": r.select(F.col("k").alias("idx"), F.col("rstd").alias("val")), "w": c.select("idx", (1 + F.col("idx") / 64).alias("val")), "b": c.select("idx", (F.col("idx") / 128).alias("val")), "dw": by_column.select("idx", F.col("dw").alias("val")), "db": by_column.select("idx", F.col("db").alias("val"))}
    layout, uri = sections.layernorm_layout(1, r.count(), 64), f"{scratch(spark, 'fixture')}/ln.bin"
    sections.write(_union(parts), uri, layout)
    return _told(sections.read(spark, uri, layout))


def _union(parts):
    out = None
    for name, df in parts.items():
        val = F.col("val") if dict(df.dtypes)["val"].startswith("array") else F.array(F.col("val").cast("double"))
        df = df.select(F.lit(name).alias("section"), F.col("idx").cast("long").alias("idx"), val.cast("array<double>").alias("val"))
        out = df if out is None else out.unionByName(df)
    return out


def _tensors(context: str) -> str:
    """SQL rows (t, first, n) of a model's tensors, whose context is an expression."""
    rows, at, more = [], 0, ""
    for k, n in SIZES.items():
        size = f"({context}) * {C}" if k == "wpe" else str(n)
        rows.append(f"SELECT '{k}' AS t, {at}{more} AS first, {size} AS n")
        at, more = (at, f" + ({context}) * {C}") if k == "wpe" else (at + n, more)
    return " UNION ALL ".join(rows)


CONTEXT = f"SELECT (64 * count(*) - {REST}) // {C} FROM embeddings"


@query("S21 K16", f"""WITH n AS (SELECT count(*) AS n FROM embeddings), k AS ({K}),
f AS (SELECT 'x' AS section, k AS idx, label::DOUBLE AS val FROM k UNION ALL SELECT 'y', k, lead(label, 1, 0) OVER (ORDER BY k)::DOUBLE FROM k UNION ALL SELECT 'logits', k * 64 + i - 1, x[i] FROM k, (SELECT unnest(range(1, 65)) AS i) UNION ALL SELECT 'loss', 0, avg(label) FROM k
  UNION ALL SELECT 'grad.' || t, v.idx - first, v.val FROM ({_tensors(CONTEXT)}) s JOIN (SELECT k * 64 + i - 1 AS idx, x[i] AS val FROM k, (SELECT unnest(range(1, 65)) AS i)) v ON v.idx >= first AND v.idx < first + s.n)
{TOLD}""")
def debug_state(spark, sf_dir):
    """A model's inputs, targets, logits, loss and gradients, made of all embeddings, as one file of sections."""
    r = _numbered(spark, sf_dir)
    n, total = r.agg(F.count(F.lit(1)), F.avg("label")).first()
    context = (64 * n - REST) // C
    after = r.select((F.col("k") - 1).alias("k"), F.col("label").alias("next"))
    y = r.join(after, "k", "left").select(F.col("k").alias("idx"), F.coalesce("next", F.lit(0)).alias("val"))
    parts = {"x": r.select(F.col("k").alias("idx"), F.col("label").alias("val")), "y": y, "logits": _flat(r, "x"), "loss": spark.range(1).select(F.col("id").alias("idx"), F.lit(float(total)).alias("val"))}
    layout, uri = sections.state_layout(1, n, context, 64, LAYERS, C, PADDED), f"{scratch(spark, 'state')}/state.bin"
    sections.write(_union(parts).unionByName(_as_tensors(r, context, "grad.")), uri, layout)
    return _told(sections.read(spark, uri, layout))


def _as_tensors(r, context: int, prefix: str = ""):
    """All values of r, end to end, as the tensors of a model with that context."""
    sizes, at, shares = binary_files.tensor_sizes(context, PADDED, LAYERS, C), 0, []
    end = F.col("idx") + F.size("val")
    for k, n in sizes.items():
        low, high = F.greatest("idx", F.lit(at)), F.least(end, F.lit(at + n))
        share = F.struct(F.lit(prefix + k).alias("section"), (low - at).cast("long").alias("idx"), F.slice("val", (low - F.col("idx") + 1).cast("int"), (high - low).cast("int")).alias("val"))
        shares.append(F.when(low < high, share))  # a run may reach over several tensors
        at += n
    return _flat(r, "x").select(F.explode(F.array(*shares)).alias("s")).where("s is not null").select("s.section", "s.idx", "s.val")


def _exported_sql() -> str:
    shapes = {"wte": None, "wpe": None, "lnfw": (1, C, False), "lnfb": (1, C, False)}
    matrix = {"qkvw": 3 * C, "attprojw": C, "fcw": 4 * C, "fcprojw": C}
    parts = []
    for k, names in sections.OUTER.items():
        for name in names:
            parts.append(f"SELECT '{name}' AS name, (v.idx - first) // {C} AS row, (v.idx - first) % {C} AS col, val FROM v JOIN s ON t = '{k}' AND v.idx >= first AND v.idx < first + " + (f"{VOCAB * C}" if k == "wte" else "n"))
    for k, (name, turned) in sections.LAYER.items():
        whole = SIZES[k] // LAYERS
        m = whole // matrix.get(k, 1)
        row, col = f"(v.idx - first) % {whole} // {m}", f"(v.idx - first) % {m}"
        parts.append(f"SELECT 'transformer.h.' || ((v.idx - first) // {whole}) || '.{name}', {col if turned else row}, {row if turned else col}, val FROM v JOIN s ON t = '{k}' AND v.idx >= first AND v.idx < first + n")
    assert set(shapes) == set(sections.OUTER)
    return " UNION ALL ".join(parts)


@query("K15 K09 S20", f"""WITH v AS (SELECT k * 64 + i - 1 AS idx, x[i]::FLOAT::DOUBLE AS val FROM ({K}), (SELECT unnest(range(1, 65)) AS i)), s AS ({_tensors(CONTEXT)}), e AS ({_exported_sql()})
SELECT name, CAST(row AS BIGINT) AS row, count(*) AS n, round(sum(val), 4) AS sum, round(sum(val * col), 3) AS place FROM e GROUP BY name, row""")
def exported_checkpoint(spark, sf_dir):
    """All embeddings as a checkpoint's values, written in stretches and exported by tiles under the other format's names."""
    r = _numbered(spark, sf_dir)
    context = (64 * r.count() - REST) // C
    layout, uri = sections.model_layout(context, VOCAB, LAYERS, HEADS, C, PADDED), f"{scratch(spark, 'model')}/model.bin"
    sections.write(_as_tensors(r, context), uri, layout)
    x = sections.export(spark, uri)
    total = lambda f: F.aggregate(F.transform("values", f), F.lit(0.0), lambda s, v: s + v)
    return x.select("name", "row", F.size("values").cast("long").alias("n"), F.round(total(lambda v, i: v.cast("double")), 4).alias("sum"), F.round(total(lambda v, i: v.cast("double") * i), 3).alias("place"))
