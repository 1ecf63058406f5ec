"""Hard-negative mining by an orthogonal PCA rotation and bounded partial products.

Components become whole numbers, floor(scale * x); a row's score is its integer product with the anchor.
Anchors are compared with all rows, a block of anchors at a time: a block is sent to the tasks, each of
which reads its rows once for it and keeps only the best of every anchor.

The rows' second moments, summed on the executors, give an orthogonal rotation whose leading axes hold
most of the rows' length. A task turns its rows and accumulates the products of the leading axes first;
what the others can add is at most the product of both residual norms, plus slack for the rounding of all
floating-point steps. Rows whose bound lies below what the anchor has already go at once; the others get
the next axes, and so on; what is left is verified by its integer product. So the rotation decides only
how much work there is: results are exact whatever the data.

First pass: an anchor's positives, its best rows of the same label. Second pass: for each positive, the
best rows of another label between `low` and `high` hundredths of its score. Ties go to the smaller id.

Products are summed as doubles where these are exact (below 2^53), as 64-bit numbers beyond; a product beyond
those counts as the largest or smallest that there is.

Memory of a task: STRIP rows by BLOCK anchors of doubles, and the best of each anchor. The driver holds a
block, its positives and one matrix of TURNED squared.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part
(nor do empty vectors). Shorter vectors count as padded with zeros. Repeated rows count each; equal
anchors are compared once and returned as often as they occur; an anchor is not its own positive,
another row that equals it is. Anchors without positives or negatives give no rows. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .graph import sized

#: Numbers of a block of anchors, about (32 MB as doubles), and anchors of one.
NUMBERS, BLOCK = 1 << 22, 2048
#: Rows that are compared at once.
STRIP = 1024
#: Shares of all axes after which bounds are looked at.
STOPS = (0.25, 0.5)
#: Axes that are turned; further ones stay as they are, after the turned ones.
TURNED = 1024
#: Pairs that are multiplied at once.
PAIRS = 1 << 16
MOST = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _clean(batch: pa.RecordBatch, d: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and whole numbers, as rows of d, of a batch (id, label, v)."""
    ids, label, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    at = v.offsets.to_numpy()
    flat = np.floor(scale * v.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64))
    n = np.diff(at)
    if (n == d).all():
        x = flat.reshape(-1, d)
    else:
        x = np.zeros((len(n), d))
        x[np.arange(d) < n[:, None]] = flat
    ok = np.isfinite(x).all(axis=1)
    return (ids, label, x) if ok.all() else (ids[ok], label[ok], x[ok])


def _whole(d: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label, x = _clean(batch, d, scale)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int64()), v], names=["id", "label", "v"])

    return run


#: Numbers of a row of the moments' table.
CUT = 64


def _moments(d: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(d, TURNED)
        total = np.zeros((k, -(-k // CUT) * CUT))
        for batch in batches:
            x = _clean(batch, d, scale)[2][:, :k]
            total[:, :k] += x.T @ x
        i, c = np.indices((k, total.shape[1] // CUT)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(c, pa.int32()), pa.array(list(total.reshape(-1, CUT)), pa.list_(pa.float64()))], names=["i", "c", "x"])

    return run


def rotation(rows: DataFrame, d: int, scale: float) -> np.ndarray:
    """Axes as columns, the one of most length first."""
    k = min(d, TURNED)
    m = rows.mapInArrow(_moments(d, scale), "i int, c int, x array<double>").groupBy("i", "c").agg(F.array(*[F.sum(F.col("x")[j]) for j in range(CUT)]).alias("x"))
    got = np.zeros((k, -(-k // CUT) * CUT))
    for r in m.collect():  # TURNED squared numbers at most
        got[r.i, r.c * CUT : (r.c + 1) * CUT] = r.x
    got = got[:, :k]
    got = np.nan_to_num(got / max(1.0, np.abs(got[np.isfinite(got)]).max(initial=0)), posinf=0, neginf=0)
    return np.linalg.eigh((got + got.T) / 2)[1][:, ::-1].copy()


class Block:
    """Anchors of a block, and of each the windows of scores that it wants the best `most` rows of:
    whole numbers (anchors, windows); one with low above high takes none."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, v: np.ndarray, same: bool, most: int, low: np.ndarray, high: np.ndarray):
        self.ids, self.label, self.v, self.same, self.most, self.low, self.high = ids, label, v, same, most, low, high


class Task:
    """The best rows of every window of a block, over the rows that a task reads."""

    def __init__(self, block: Block, axes: np.ndarray):
        self.b, self.axes = block, axes
        n, d = block.v.shape
        self.stops = sorted({max(1, int(d * s)) for s in STOPS} | {d})
        self.turned = self.turn(block.v)
        self.rest = self.residuals(self.turned)
        self.length = np.sqrt((block.v**2).sum(axis=1))
        self.top = float(np.abs(block.v).max(initial=0))
        self.least = block.low.copy()  # what a score must reach
        self.below = np.nextafter(self.least.astype(np.float64), -np.inf)
        self.above = np.nextafter(block.high.astype(np.float64), np.inf)
        self.below[self.least == -MOST], self.above[block.high == MOST] = -np.inf, np.inf  # also for products beyond 64 bits
        none = block.low > block.high
        self.below[none], self.above[none] = np.inf, -np.inf
        self.slot, self.score, self.id, self.own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def turn(self, x: np.ndarray) -> np.ndarray:
        k = len(self.axes)
        return np.hstack([x[:, :k] @ self.axes, x[:, k:]])

    def residuals(self, z: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt((z[:, s:] ** 2).sum(axis=1)) for s in self.stops]

    def exact(self, x: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Integer products of rows r and anchors k."""
        a, largest = self.b.v, x.shape[1] * float(np.abs(x).max(initial=0)) * self.top
        if largest >= 2.0**62:
            return np.array([max(-MOST, min(MOST, sum(int(p) * int(q) for p, q in zip(x[i], a[j])))) for i, j in zip(r.tolist(), k.tolist())], np.int64)
        if largest >= 2.0**53:
            x, a = x.astype(np.int64), a.astype(np.int64)
        elif 8 * len(r) > len(x) * len(a):
            return (x @ a.T)[r, k].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", x[r[i : i + PAIRS]], a[k[i : i + PAIRS]]) for i in range(0, max(1, len(r)), PAIRS)]).astype(np.int64)

    def strip(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        b, z = self.b, self.turn(x)
        rest, length = self.residuals(z), np.sqrt((x**2).sum(axis=1))
        slack = 64 * np.finfo(np.float64).eps * (x.shape[1] + 8) * length
        part = z[:, : self.stops[0]] @ self.turned[:, : self.stops[0]].T
        bound = rest[0][:, None] * self.rest[0] + slack[:, None] * self.length
        maybe = np.zeros(part.shape, bool)
        for w in range(b.low.shape[1]):
            maybe |= (part + bound >= self.below[:, w]) & (part - bound <= self.above[:, w])
        maybe &= (label[:, None] == b.label) == b.same
        r, k = np.nonzero(maybe)
        p = part[r, k]
        for i in range(1, len(self.stops) - 1):
            if 8 * len(r) > maybe.size:
                break  # a product of whole matrices costs less
            lo, hi = self.stops[i - 1], self.stops[i]
            p = p + np.concatenate([np.einsum("ij,ij->i", z[r[c : c + PAIRS], lo:hi], self.turned[k[c : c + PAIRS], lo:hi]) for c in range(0, max(1, len(r)), PAIRS)])
            bound = rest[i][r] * self.rest[i][k] + slack[r] * self.length[k]
            left = ((p + bound)[:, None] >= self.below[k]) & ((p - bound)[:, None] <= self.above[k])
            left = left.any(axis=1)
            r, k, p = r[left], k[left], p[left]
        self.keep(ids, x, r, k, self.exact(x, r, k))

    def keep(self, ids: np.ndarray, x: np.ndarray, r: np.ndarray, k: np.ndarray, s: np.ndarray) -> None:
        b, w = self.b, self.b.low.shape[1]
        fits = (s[:, None] >= self.least[k]) & (s[:, None] <= b.high[k])
        i, j = np.nonzero(fits)
        if not len(i):
            return
        r, k, s = r[i], k[i], s[i]
        own = np.zeros(len(r), bool)
        if b.same:
            own = ids[r] == b.ids[k]
            own[own] = (x[r[own]] == b.v[k[own]]).all(axis=1)
        slot, score, ident, own = (np.concatenate([old, new]) for old, new in ((self.slot, k * w + j), (self.score, s), (self.id, ids[r]), (self.own, own)))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident, own = slot[order], score[order], ident[order], own[order]
        start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(start, np.diff(np.r_[start, len(slot)]))
        full = np.flatnonzero(place == b.most - 1)
        a, j = slot[full] // w, slot[full] % w
        self.least[a, j] = np.maximum(self.least[a, j], score[full])
        self.below[a, j] = np.nextafter(self.least[a, j].astype(np.float64), -np.inf)
        kept = place < b.most
        self.slot, self.score, self.id, self.own = slot[kept], score[kept], ident[kept], own[kept]

    def rows(self) -> pa.RecordBatch:
        w = self.b.low.shape[1]
        cols = [pa.array(self.slot // w, pa.int32()), pa.array(self.slot % w, pa.int32()), pa.array(self.own), pa.array(self.id), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "window", "own", "id", "score"])


def _best(block: Block, axes: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(block, axes)
        for batch in batches:
            ids, label, x = _clean(batch, block.v.shape[1], scale)
            for i in range(0, len(ids), STRIP):
                task.strip(ids[i : i + STRIP], label[i : i + STRIP], x[i : i + STRIP])
        yield task.rows()

    return run


def _ranked(found: DataFrame, most: int, *by: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", at).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Callable[[Column, Column], Column] | None = None,
         scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchor tells of an id whether
    its row is one; relabel makes a label of id and label."""
    spark = rows.sparkSession
    r = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    r = r.where("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    if relabel is not None:
        r = r.withColumn("label", relabel(F.col("id"), F.col("label")).cast("long")).where("label IS NOT NULL")
    d = int(r.agg(F.max(F.size("v"))).first()[0] or 0)
    if not d:
        return spark.createDataFrame([], RESULT)
    axes = rotation(r, d, scale)
    whole = r.where(anchor(F.col("id"))).mapInArrow(_whole(d, scale), "id long, label long, v array<double>")
    anchors, n, _ = sized(whole.groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")), "negatives_anchors")
    blocks, paths = -(-n // max(1, min(block, NUMBERS // d))), []
    for i in range(blocks):
        got = anchors.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == i).toArrow()  # about `block` rows
        if not len(got):
            continue
        ids, labels, copies = (got.column(c).to_numpy() for c in ("id", "label", "copies"))
        v = np.array(got.column("v").to_pylist(), np.float64)
        every = Block(ids, labels, v, True, positives + 1, np.full((len(ids), 1), -MOST), np.full((len(ids), 1), MOST))
        near = r.mapInArrow(_best(every, axes, scale), "anchor int, window int, own boolean, id long, score long")
        # one of the rows that equal the anchor is the anchor
        self_ = F.row_number().over(Window.partitionBy("anchor", "own").orderBy(F.col("score").desc(), "id"))
        near = _ranked(_ranked(near, positives + 1, "anchor").withColumn("nth", self_).where("NOT own OR nth > 1"), positives, "anchor").select("anchor", "rank", "id", "score").collect()
        lows, highs = np.full((len(ids), positives), MOST), np.full((len(ids), positives), -MOST)
        wanted = []
        for p in near:  # Python's whole numbers: a hundredfold score may leave 64 bits
            lows[p.anchor, p.rank - 1], highs[p.anchor, p.rank - 1] = -((-low * p.score) // 100), (high * p.score) // 100
            wanted.append((p.anchor, p.rank - 1, int(ids[p.anchor]), p.id, p.score, int(copies[p.anchor])))
        if not wanted:
            continue
        some = Block(ids, labels, v, False, negatives, lows, highs)
        far = _ranked(r.mapInArrow(_best(some, axes, scale), "anchor int, window int, own boolean, id long, score long"), negatives, "anchor", "window")
        of = spark.createDataFrame(wanted, "anchor int, window int, anchor_id long, positive_id long, positive_score long, copies long")
        out = far.join(F.broadcast(of), ["anchor", "window"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        paths.append(scratch(spark, "negatives"))
        out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(paths[-1])
    return spark.read.schema(RESULT).parquet(*paths) if paths else spark.createDataFrame([], RESULT)
