"""Training and generation with a whole language model, data-parallel.

The model's values are a flat vector in the order of the checkpoint's tensors; it goes to the executors with each
step's closure, so its size is bounded by what one task can hold. Every task runs forward and backward over the rows it
has and gives one partial gradient, which are summed by position; the optimiser's state is a table that is written each
step (`stored`), so a lost executor costs a step at most. Forward and backward are NumPy over blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.binary_files import TENSORS
from . import optim


@dataclass(frozen=True)
class Config:
    vocabulary: int
    context: int
    layers: int
    heads: int
    channels: int

    def shapes(self) -> dict[str, tuple[int, ...]]:
        n, c = self.layers, self.channels
        one = ((self.vocabulary, c), (self.context, c), (n, c), (n, c), (n, 3 * c, c), (n, 3 * c), (n, c, c), (n, c), (n, c), (n, c), (n, 4 * c, c), (n, 4 * c), (n, c, 4 * c), (n, c), (c,), (c,))
        return dict(zip(TENSORS, one))

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())


TINY = Config(vocabulary=32, context=8, layers=2, heads=2, channels=8)
#: Rows that go through the model at once, and rows of a file of training rows.
BLOCK, ROWS = 256, 8192
EPS = 1e-5


def tensors(flat: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    """Views of the flat vector."""
    out, at = {}, 0
    for name, shape in c.shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(c: Config, seed: int = 42) -> np.ndarray:
    """Values by the model's own rule: see `optim.initial`."""
    rng, flat = np.random.default_rng(seed), np.zeros(c.size())
    for name, t in tensors(flat, c).items():
        if name in ("ln1w", "ln2w", "lnfw"):
            t[...] = 1
        elif not name.endswith("b"):
            t[...] = rng.normal(0, 0.02 / (np.sqrt(2 * c.layers) if name in ("attprojw", "fcprojw") else 1), t.shape)
    return flat


def _norm(x, w, b):
    m = x.mean(-1, keepdims=True)
    r = 1 / np.sqrt(((x - m) ** 2).mean(-1, keepdims=True) + EPS)
    z = (x - m) * r
    return z * w + b, (z, r, w)


def _norm_back(d, kept):
    z, r, w = kept
    dz = d * w
    dx = (dz - dz.mean(-1, keepdims=True) - z * (dz * z).mean(-1, keepdims=True)) * r
    axes = tuple(range(d.ndim - 1))
    return dx, (d * z).sum(axes), d.sum(axes)


_ROOT = np.sqrt(2 / np.pi)


def forward(p: dict[str, np.ndarray], tok: np.ndarray, c: Config) -> tuple[np.ndarray, list]:
    """(logits of tok (rows, t), what the backward step needs)."""
    rows, t = tok.shape
    x = p["wte"][tok] + p["wpe"][:t]
    split = lambda y: y.reshape(rows, t, c.heads, -1).swapaxes(1, 2)
    mask, scale, kept = np.tril(np.ones((t, t), bool)), 1 / np.sqrt(c.channels / c.heads), []
    for i in range(c.layers):
        n1, k1 = _norm(x, p["ln1w"][i], p["ln1b"][i])
        q, k, v = (split(y) for y in np.split(n1 @ p["qkvw"][i].T + p["qkvb"][i], 3, -1))
        s = np.where(mask, q @ k.swapaxes(2, 3) * scale, -np.inf)
        a = np.exp(s - s.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        y = (a @ v).swapaxes(1, 2).reshape(rows, t, -1)
        x = x + y @ p["attprojw"][i].T + p["attprojb"][i]
        n2, k2 = _norm(x, p["ln2w"][i], p["ln2b"][i])
        h = n2 @ p["fcw"][i].T + p["fcb"][i]
        u = np.tanh(_ROOT * (h + 0.044715 * h * h * h))
        g = 0.5 * h * (1 + u)
        x = x + g @ p["fcprojw"][i].T + p["fcprojb"][i]
        kept.append((n1, k1, q, k, v, a, y, n2, k2, h, u, g))
    nf, kf = _norm(x, p["lnfw"], p["lnfb"])
    return nf @ p["wte"].T, [kept, nf, kf]


def gradient(flat: np.ndarray, tok: np.ndarray, c: Config) -> tuple[float, np.ndarray]:
    """(loss, its gradient), both summed over the targets: tok (rows, t + 1)."""
    p, out = tensors(flat, c), np.zeros_like(flat)
    d, inp, target = tensors(out, c), tok[:, :-1], tok[:, 1:]
    logits, (kept, nf, kf) = forward(p, inp, c)
    rows, t = inp.shape
    e = np.exp(logits - logits.max(-1, keepdims=True))
    e /= e.sum(-1, keepdims=True)
    at = np.arange(rows)[:, None], np.arange(t)[None], target
    loss = float(-np.log(np.maximum(e[at], 1e-300)).sum())
    e[at] -= 1
    both = lambda a, b: a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])
    merge = lambda y: y.swapaxes(1, 2).reshape(rows, t, -1)
    split = lambda y: y.reshape(rows, t, c.heads, -1).swapaxes(1, 2)
    d["wte"] += both(e, nf)
    dx, d["lnfw"][...], d["lnfb"][...] = _norm_back(e @ p["wte"], kf)
    scale = 1 / np.sqrt(c.channels / c.heads)
    for i in reversed(range(c.layers)):
        n1, k1, q, k, v, a, y, n2, k2, h, u, g = kept[i]
        d["fcprojw"][i], d["fcprojb"][i] = both(dx, g), dx.sum((0, 1))
        slope = 0.5 * (1 + u) + 0.5 * h * (1 - u * u) * _ROOT * (1 + 3 * 0.044715 * h * h)
        dh = dx @ p["fcprojw"][i] * slope
        d["fcw"][i], d["fcb"][i] = both(dh, n2), dh.sum((0, 1))
        more, d["ln2w"][i], d["ln2b"][i] = _norm_back(dh @ p["fcw"][i], k2)
        dx = dx + more
        d["attprojw"][i], d["attprojb"][i] = both(dx, y), dx.sum((0, 1))
        dy = split(dx @ p["attprojw"][i])
        da = dy @ v.swapaxes(2, 3)
        ds = a * (da - (a * da).sum(-1, keepdims=True)) * scale
        dqkv = np.concatenate([merge(ds @ k), merge(ds.swapaxes(2, 3) @ q), merge(a.swapaxes(2, 3) @ dy)], -1)
        d["qkvw"][i], d["qkvb"][i] = both(dqkv, n1), dqkv.sum((0, 1))
        more, d["ln1w"][i], d["ln1b"][i] = _norm_back(dqkv @ p["qkvw"][i], k1)
        dx = dx + more
    d["wpe"][:t] += dx.sum(0)
    hot = np.zeros((inp.size, c.vocabulary))
    hot[np.arange(inp.size), inp.ravel()] = 1
    d["wte"] += hot.T @ dx.reshape(-1, c.channels)
    return loss, out


def batches_of(docs: DataFrame, text: str, c: Config) -> DataFrame:
    """(tok): rows of context + 1 tokens of each text's words, a word's token being its hash; the rest is dropped."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    tok = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(c.vocabulary)))
    n = c.context + 1
    rows = docs.where(F.col(text).isNotNull()).select(tok.alias("t")).where(F.size("t") >= n)
    return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / n).cast("int") - 1), lambda i: F.slice("t", i * n + 1, F.lit(n)))).alias("tok"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            tok = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            for lo in range(0, len(tok), BLOCK):
                yield tok[lo : lo + BLOCK]


def gradients(rows: DataFrame, flat: np.ndarray, c: Config) -> DataFrame:
    """(i, g): the gradient summed over all targets, the summed loss at i = -1, and the number of targets at i = -2. A task
    gives one partial vector, which are summed by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros_like(flat), 0.0, 0
        for tok in _blocks(batches):
            part, g = gradient(flat, tok, c)
            total, loss, n = total + g, loss + part, n + tok.shape[0] * (tok.shape[1] - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(total))), pa.array(np.concatenate([[n, loss], total]))], names=["i", "g"])

    return rows.mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g"))


def train(rows: DataFrame, c: Config, steps: int, lr: float = 1e-2, clip: float = 1.0, seed: int = 42) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """([(step, mean loss, gradient norm)], the values after the last step)."""
    spark, flat, log = rows.sparkSession, initial(c, seed), []
    state = spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in enumerate(flat)], "i long, p double, m double, v double")
    for step in range(1, steps + 1):
        g = stored(gradients(rows, flat, c), "gradients")
        n, loss = (float(x[0]) for x in (g.where(f"i = {k}").select("g").first() or (0.0,) for k in (-2, -1)))
        if not n:
            break
        mean = g.where("i >= 0").withColumn("g", F.col("g") / n)
        norm, scale = optim.clip_scale(mean, "g", clip).first()
        new = optim.adamw(F.col("p"), F.col("g") * scale, F.col("m"), F.col("v"), step, lr)
        state = stored(state.join(mean, "i").select("i", *[x.alias(k) for k, x in new.items()]), "optimizer-state")
        # the model is what one task holds; it goes back to the closure of the next step
        flat = state.orderBy("i").select("p").toPandas()["p"].to_numpy(np.float64)
        log.append((step, loss / n, float(norm)))
    return log, flat


def losses(rows: DataFrame, c: Config, steps: int) -> DataFrame:
    """(step, loss, norm) of a training run. Rows are dealt out evenly first: a text table of few files has few tasks."""
    rows = rows.repartition(1 + rows.count() // ROWS)
    return rows.sparkSession.createDataFrame(train(stored(rows, "training-rows"), c, steps)[0], "step long, loss double, norm double")


def generated(rows: DataFrame, c: Config, prompt: int, most: int, flat: np.ndarray | None = None) -> DataFrame:
    """(prompt, made): each row's first tokens, and `most` tokens that the model goes on with, the likeliest each time,
    the least of equally likely ones. Beyond the context the oldest tokens are out of sight."""
    flat = initial(c) if flat is None else flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = tensors(flat, c)
        for tok in _blocks(batches):
            seen = tok[:, :prompt]
            for _ in range(most):
                logits, _ = forward(p, seen[:, -c.context :], c)
                seen = np.concatenate([seen, logits[:, -1].argmax(-1)[:, None]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int64())) for x in (seen[:, :prompt], seen[:, prompt:])], names=["prompt", "made"])

    return rows.mapInArrow(run, "prompt array<long>, made array<long>")
