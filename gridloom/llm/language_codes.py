"""Language identification with error-correcting output codes.

Each language has a codeword of bits (all splits of the languages in two for up to five of them,
else seeded random balanced columns, 12 log2 K of them). For each bit a binary classifier reads a
text as its character n-grams (three bytes inside a word, with the space that starts it, hashed to
2^15 cells): the weight of a cell is the smoothed log ratio of its rates under the bit's two sides,
and the bit's margin is the mean weight over the text, scaled by its spread on the training sample.
Decoding is weighted by loss: a language costs the sum over bits of the bit's training accuracy
times the logistic loss of its margin under the language's bit. The least cost wins; the score is the
softmax of the negative costs, and where the runner-up comes within `near` of it the text is marked
ambiguous.

Learns from about `most` documents of known language outside the held-out fold (bounded, uniform over
rows, those without an id included).

Defined cases: a null text, or one without a letter: `und`, score 0. Rows that repeat are returned
each; other columns are ignored. With no row to learn from every text is `und`. An empty table gives
an empty result. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textvec as tv
from .models import held_out, sample

#: Documents that a model is fitted on, about.
SAMPLE = 6_000
CELLS = 1 << 15
_SPREAD = tv.mix(np.arange(256 * 3, dtype=np.uint64), 71).astype(np.uint32).reshape(3, 256)
_FOLD = tv._LOWER.copy()
_FOLD[tv._SPACE] = 32
# digits and ASCII signs tell nothing of a language
_FOLD[[c for c in range(33, 127) if not chr(c).isalpha()]] = 32


def cells(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each 3-gram, bounds of each document). A 3-gram of blanks alone isn't one."""
    b = _FOLD[c.bytes]
    n = len(b)
    if n < 3:
        return np.zeros(0, np.int32), np.zeros(c.n + 1, np.int64)
    h = _SPREAD[0][b[:-2]] + _SPREAD[1][b[1:-1]] + _SPREAD[2][b[2:]]
    ok = (b[1:-1] != 32) & ((b[:-2] != 32) | (b[2:] != 32))
    ends = c.off[1:-1]
    for back in (1, 2):  # no 3-gram crosses from one document into the next
        at = ends - back
        ok[at[(at >= 0) & (at < n - 2)]] = False
    first = np.concatenate([[0], np.cumsum(ok)])
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(17))[ok].astype(np.int32), first[np.minimum(c.off, n - 2)]


def code(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of 1 and -1."""
    if k <= 5:
        bits = np.array([[1 if j >> i & 1 else -1 for j in range(1, 1 << (k - 1))] for i in range(k)]) if k > 1 else np.ones((1, 1))
        return bits.astype(np.float64)
    rng = np.random.default_rng(seed)
    cols = [rng.permutation(np.where(np.arange(k) % 2, 1, -1)) for _ in range(int(np.ceil(12 * np.log2(k))))]
    return np.array(cols, np.float64).T


class Model:
    """langs, their codewords, the weight of each cell for each bit; margins are centred at mid and
    scaled by scale, and bits weigh by trust (see `calibrated`)."""

    def __init__(self, langs: list[str], counts: np.ndarray, near: float):
        """counts: how often each language of the sample has each cell."""
        self.langs, self.code, self.near = langs, code(len(langs)), near
        k = len(langs)
        # languages weigh alike however many texts they have
        rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * CELLS)
        self.table = np.zeros((CELLS, self.code.shape[1]), np.float32)
        for j, bit in enumerate(self.code.T):
            if k > 1:
                self.table[:, j] = np.log(rate[bit > 0].mean(0)) - np.log(rate[bit < 0].mean(0))
        self.table = np.clip(self.table, -4, 4)
        bits = self.code.shape[1]
        self.mid, self.scale, self.trust = np.zeros(bits), np.ones(bits), np.ones(bits)

    def calibrated(self, raw: np.ndarray, y: np.ndarray) -> "Model":
        """Centres margins between a bit's two sides, scales them by their spread, and tells how far to
        trust each bit; raw: mean weights of the sample's texts, y: their languages."""
        truth = self.code[y]
        if len(self.langs) > 1:
            for j in range(raw.shape[1]):
                up, down = raw[truth[:, j] > 0, j], raw[truth[:, j] < 0, j]
                self.mid[j] = (np.median(up) + np.median(down)) / 2
                self.scale[j] = max(1e-3, (np.median(up) - np.median(down)) / 8)
                self.trust[j] = max(0.0, 2 * ((raw[:, j] > self.mid[j]) == (truth[:, j] > 0)).mean() - 1)
        return self

    def _mean(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty((len(first) - 1, self.table.shape[1]))
        n = np.maximum(np.diff(first), 1)
        for j in range(self.table.shape[1]):
            out[:, j] = tv.per_doc(self.table[:, j].astype(np.float64)[g], first) / n
        return out

    def predict(self, c: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each document."""
        margin = (self._mean(*cells(c)) - self.mid) / self.scale
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        cost = (loss * self.trust).sum(2) / max(1e-9, self.trust.sum())
        p = np.exp(-(cost - cost.min(1, keepdims=True)) * 4)
        p /= p.sum(1, keepdims=True)
        best = cost.argmin(1)
        ordered = np.sort(cost, axis=1)
        return best, p[np.arange(c.n), best], (ordered[:, 1] - ordered[:, 0] < self.near) if cost.shape[1] > 1 else np.zeros(c.n, bool)


def _apply(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1), batch.column(2)
            for c in tv.chunks(texts):
                best, score, near = model.predict(c) if model else (np.zeros(c.n, int), np.zeros(c.n), np.zeros(c.n, bool))
                langs = []
                for i in range(c.n):
                    text = texts[c.lo + i].as_py() or ""
                    if model and any(ch.isalpha() for ch in text):
                        langs.append(model.langs[best[i]])
                    else:
                        langs.append("und")
                        score[i], near[i] = 0.0, False
                yield pa.RecordBatch.from_arrays([ids.slice(c.lo, c.n), held.slice(c.lo, c.n), pa.array(langs), pa.array(np.clip(score, 0, 1)), pa.array(near)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def _counted(langs: list[str]):
    """(y, cell, n) of the texts of a split: how often language y has the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * CELLS, np.int64)
        for batch in batches:
            y = np.array([langs.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for c in tv.chunks(batch.column(0)):
                g, first = cells(c)
                total += np.bincount(np.repeat(y[c.lo : c.hi], np.diff(first)) * CELLS + g, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    return run


def _margins(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array([model.langs.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for c in tv.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(y[c.lo : c.hi]), pa.array(model._mean(*cells(c)).tolist(), pa.list_(pa.float64()))], names=["y", "raw"])

    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE, near: float = 0.15) -> Model | None:
    """A model of the languages of docs; its size depends on their number alone. Texts stay on the
    executors: the driver gets counts of cells (CELLS a language) and a margin a bit of each sampled text."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    rows = stored(sample(known.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")), most), "language-sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    got = rows.mapInArrow(_counted(langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(langs) * CELLS)
    counts[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    model = Model(langs, counts.reshape(len(langs), CELLS), near)
    if len(langs) == 1:
        return model
    seen = rows.mapInArrow(_margins(model), "y long, raw array<double>").toPandas()
    return model.calibrated(np.array(seen["raw"].tolist()), seen["y"].to_numpy(np.int64))


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; a row for each row."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_apply(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
