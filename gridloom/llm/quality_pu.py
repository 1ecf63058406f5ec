"""Quality classification by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; all other web text counts as unlabelled,
whatever it is. The classifier minimises the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with logistic loss over statistics of the whole text, where pi, the share of positives among the
unlabelled, is estimated: half of the positives train a first classifier against the unlabelled, the
other half tells how high positives score, and pi is the unlabelled share above that level, corrected
for it (kept within 0.01 to 0.99, so that neither side of the risk vanishes).

Statistics are computed for whole chunks of bytes at once: shares of capitals, letters, digits,
signs, symbols, bars, exclamation marks, spaces and non-ASCII bytes, word length, repeated words and
repeated word pairs, lines a word, and the logarithm of the length.

Learns from about `most` positives and as many unlabelled documents, none of the held-out fold; what
reaches the driver are their statistics (112 bytes each), however long the texts and whatever the ids.

Defined cases: a null or empty text has statistics 0 and gets the score of that. Rows that repeat
are returned each; labels without a document or an id and null labels teach nothing; documents without
an id are unlabelled text like others; with no positive to learn from every score is 1 (nothing is rejected without grounds). Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .models import adam, held_out, logistic, sample, sigmoid, weighed

#: Positives that a model is fitted on, and unlabelled documents, about.
SAMPLE = 8_000
NAMES = ("upper", "letter", "digit", "sign", "symbol", "bar", "shout", "space", "high", "word", "again", "pairs", "lines", "length")

_CLASS = np.zeros((9, 256), bool)
for _c in range(256):
    _x = chr(_c)
    _CLASS[0, _c] = 65 <= _c <= 90
    _CLASS[1, _c] = _c < 128 and _x.isalpha()
    _CLASS[2, _c] = 48 <= _c <= 57
    _CLASS[3, _c] = _x in ".,;:?'\"()-"
    _CLASS[4, _c] = _x in "#*$%&<>@=+~^_{}[]\\/"
    _CLASS[5, _c] = _x == "|"
    _CLASS[6, _c] = _x == "!"
    _CLASS[7, _c] = bool(tv._SPACE[_c])
    _CLASS[8, _c] = _c >= 128


def features(c: tv.Chunk) -> np.ndarray:
    n = np.maximum(np.diff(c.off), 1).astype(np.float64)
    out = np.zeros((c.n, len(NAMES)))
    # classes packed in one gather: counts of a byte's class by document
    kind = _KIND[c.bytes]
    for j in range(9):
        running = np.concatenate([[0], np.cumsum(kind == j, dtype=np.int64)]) if j else None
        if j:
            out[:, j] = (running[c.off[1:]] - running[c.off[:-1]]) / n
    upper = np.concatenate([[0], np.cumsum(kind == 0, dtype=np.int64)])
    out[:, 0] = (upper[c.off[1:]] - upper[c.off[:-1]]) / n
    w = tv.Words(c)
    count = np.maximum(w.count(), 1)
    out[:, 9] = np.minimum(3, np.log1p(tv.per_doc(w.end - w.start, w.first) / count))
    h = w.hashes()
    own, first = tv.sets(h, w.doc(), c.n)
    # of very few words repetition says nothing
    fade = np.minimum(1, count / 50)
    out[:, 10] = (1 - np.diff(first) / count) * fade
    g, doc, _ = tv.grams(h, w.first, 2)
    _, first2 = tv.sets(g, doc, c.n)
    out[:, 11] = (1 - np.diff(first2) / np.maximum(count - 1, 1)).clip(0) * fade
    lines = np.concatenate([[0], np.cumsum(c.bytes == 10, dtype=np.int64)])
    out[:, 12] = (lines[c.off[1:]] - lines[c.off[:-1]]) / count
    out[:, 13] = np.log1p(n) / 10
    out[np.diff(c.off) == 0] = 0
    return out


_KIND = np.full(256, 9, np.uint8)
for _j in range(8, -1, -1):
    _KIND[_CLASS[_j]] = _j


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, f: np.ndarray) -> np.ndarray:
        return sigmoid(weighed(_wide((f - self.mean) / self.scale), self.weights))


def _wide(z: np.ndarray) -> np.ndarray:
    """Each statistic, bent both ways, and an intercept: the junk is at either end of some."""
    z = z.clip(-6, 6)
    return np.column_stack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), np.ones(len(z))])


def risk(w: np.ndarray, zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk with logistic loss, and the direction that a step descends: its
    gradient, or, where the risk of unlabelled text as negatives is below 0 and so overfits, minus the
    gradient of that part alone."""
    ap, au = zp @ w, zu @ w
    sp, su = sigmoid(ap), sigmoid(au)
    positive = prior * np.logaddexp(0, -ap).mean()
    negative = (np.logaddexp(0, au).mean() if len(zu) else 0.0) - prior * np.logaddexp(0, ap).mean()
    up = -prior * (zp.T @ (1 - sp)) / len(zp)
    down = (zu.T @ su) / max(1, len(zu)) - prior * (zp.T @ sp) / len(zp)
    return positive + max(0.0, negative), up + down if negative >= 0 else -down


def fit_arrays(p: np.ndarray, u: np.ndarray, steps: int = 600, ridge: float = 1e-3) -> Model:
    """The model of positives p and unlabelled u (statistics)."""
    mean = p.mean(0)
    scale = np.maximum(np.minimum(p.std(0), 1e3), 1e-3)
    zp, zu = _wide((p - mean) / scale), _wide((u - mean) / scale)
    half = np.arange(len(zp)) % 2 == 0
    x, y = np.vstack([zp[half], zu]), np.concatenate([np.ones(half.sum()), np.zeros(len(zu))])
    w = logistic(x[:, :-1], y, np.where(y == 1, 0.5 / max(1, half.sum()), 0.5 / max(1, len(zu))), steps=300)
    rest = zp[~half] if (~half).any() else zp
    level = np.quantile(np.column_stack([rest[:, :-1], np.ones(len(rest))]) @ w, 0.1)
    above = ((np.column_stack([zu[:, :-1], np.ones(len(zu))]) @ w) >= level).mean() if len(zu) else 0.9
    prior = float(np.clip(above / 0.9, 0.01, 0.99))
    keep = np.append(np.full(zp.shape[1] - 1, ridge), 0)
    grad = lambda w: risk(w, zp, zu, prior)[1] + keep * w
    return Model(mean, scale, adam(grad, np.zeros(zp.shape[1]), steps), prior)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in tv.chunks(batch.column(0)):
            f = features(c)
            yield pa.RecordBatch.from_arrays([pa.array(f.tolist(), pa.list_(pa.float64())), batch.column(1).slice(c.lo, c.n)], names=["f", "trusted"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model | None:
    trusted = labels.where((F.col("quality") == 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("doc_id")).distinct()
    d = docs.where(~held_out(key)).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most about `most` ids, and of the rows that have them as many: one id can be that of many rows
    p = sample(d.join(F.broadcast(sample(trusted, most)), "doc_id"), most).select("text", F.lit(True).alias("trusted"))
    u = sample(d, most).select("text", F.lit(False).alias("trusted"))
    got = p.unionByName(u).mapInArrow(tv.tidy(_stats), "f array<double>, trusted boolean").toPandas()
    mine = got["trusted"].to_numpy(bool)
    if mine.sum() < 2 or (~mine).sum() < 2:
        return None
    f = np.array(got["f"].tolist())
    return fit_arrays(f[mine], f[~mine])


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(2)):
                s = model.score(features(c)) if model else np.ones(c.n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), batch.column(1).slice(c.lo, c.n), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each row."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(tv.tidy(_scored(model)), "doc_id long, held_out boolean, score double, predicted int")


def _kept(model: Model | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for c in tv.chunks(batch.column(at)):
                s = model.score(features(c)) if model else np.ones(c.n)
                yield batch.slice(c.lo, c.n).filter(pa.array(s >= least))

    return run


def keep(docs: DataFrame, model: Model | None, least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `least`."""
    return docs.mapInArrow(tv.tidy(_kept(model, least)), docs.schema)
