"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits (ASCII signs part words, A-Z fold). Seeds are four words, in a row
or with any one word between the second and the third: so a word changed, put in or left out between two
pairs that stayed leaves a seed. The items' seeds are counted over all documents; of each item those are
rare that are in no more documents than four times the item's lower quartile, plus 16. A seed in a
document places the item there; places that agree within a quarter of the item's length make one window,
and the item is aligned with the window's words (match 2, other word -1, gap -1). A score of at least
`least` of a full match is a leak. A rare seed is enough by itself; windows that only common ones place
are aligned unless they hold too few of the item's words to reach `least`, which loses no leak. So a
document that shares any seed with an item is judged by its score alone, however many documents share it.
Items of SEED to SHORTEST - 1 words are leaks only where they stand whole.

Places of a seed that an item repeats are thinned to steps of an eighth of the item, which moves no
window's border: the work on a pair grows with their lengths, not with the product of repeats.

The benchmark goes to the executors in blocks of about BLOCK words (a bound on what is broadcast),
each block against all documents. Documents are read whole and never shuffled.

Defined cases: null or empty texts and items match nothing; items of fewer than SEED words are ordinary
phrases and not searched; equal items are reported each; repeated rows are reported each; of equal scores
in one document the first is reported; other columns are ignored; either table may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Words of a seed, and where they stand in its two forms.
SEED, FORMS = 4, ((0, 1, 2, 3), (0, 1, 3, 4))
#: Words of an item from which on edited copies are looked for.
SHORTEST = 8
BLOCK = 1_000_000
LEAST = 0.5

U = np.uint64
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _words(c: tv.Chunk) -> tuple[tv.Words, np.ndarray]:
    b = c.bytes.copy()
    b[_SIGN[b]] = 32
    d = tv.Chunk.__new__(tv.Chunk)
    d.lo, d.hi, d.n, d.off, d.bytes = c.lo, c.hi, c.n, c.off, b
    w = tv.Words(d)
    return w, w.hashes()


def seeds(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place of the first word) of each seed; first: bounds of each document's words."""
    found = []
    for form in FORMS:
        count = np.maximum(np.diff(first) - form[-1], 0)
        doc = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
        h = np.zeros(len(doc), U)
        for j, k in enumerate(form):
            h += word[start + k] * tv._PLACE[j]
        found.append((tv.mix(h, 23), doc, start))
    return tuple(np.concatenate(x) for x in zip(*found))


class Items:
    """Benchmark items as word hashes, with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words, grams, item, place = [], [], [], [], []
        for c in tv.chunks(pa.array(texts, pa.string()), 1 << 30):
            w, h = _words(c)
            for d in range(c.n):
                own = h[w.first[d] : w.first[d + 1]]
                if len(own) >= SEED:
                    g, _, at = seeds(own, np.array([0, len(own)]))
                    thin = at // max(1, len(own) // 8)
                    _, keep = np.unique(np.column_stack([g, thin.astype(U)]), axis=0, return_index=True)
                    g, at = g[keep], at[keep]
                    item += [len(self.ids)] * len(g)
                    grams.append(g)
                    place.append(at)
                    self.ids.append(ids[c.lo + d])
                    self.words.append(own)
        g = np.concatenate(grams) if grams else np.zeros(0, U)
        order = np.argsort(g, kind="stable")
        self.gram, self.item = g[order], np.array(item, np.int64)[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.distinct = np.unique(self.gram)
        self.rare = np.ones(len(self.gram), bool)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.distinct >> U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, index of distinct) of each of h that is one of the distinct seeds."""
        at = np.flatnonzero(self.maybe[(h >> U(44)).astype(np.int64)])
        if not len(self.distinct) or not at.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.distinct, h[at]), len(self.distinct) - 1)
        same = self.distinct[k] == h[at]
        return at[same], k[same]

    def seeded(self, df: np.ndarray) -> "Items":
        """Marks the rare grams of each item; df: documents of each distinct gram."""
        count = df[np.searchsorted(self.distinct, self.gram)]
        by = np.lexsort((count, self.item))
        first = np.searchsorted(self.item[by], np.arange(len(self.ids) + 1))
        limit = 4 * count[by][first[:-1] + (np.diff(first) - 1) // 4] + 16
        self.rare = count <= limit[self.item]
        return self


def possible(item: np.ndarray, window: np.ndarray, least: float) -> bool:
    """Whether the window holds enough of the item's words for a score of least: 2 for each at most."""
    held = (item[:, None] == window).any(1) if len(window) <= 512 else np.isin(item, window)
    return int(held.sum()) >= least * len(item)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment: (score, end in the window). Ties go to the first end."""
    step = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for x in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(window == x, 2, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + step) - step
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k
        row = new
    return best, end


def leaks(items: Items, least: float, c: tv.Chunk) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word) of the chunk's leaks; the best of each pair."""
    w, h = _words(c)
    g, doc, start = seeds(h, w.first)
    at, k = items.find(g)
    if not at.size:
        return []
    lo = np.searchsorted(items.gram, items.distinct[k], side="left")
    n = np.searchsorted(items.gram, items.distinct[k], side="right") - lo
    hit = np.repeat(np.arange(len(at)), n)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + lo[hit]
    d, item, begin = doc[at][hit], items.item[entry], start[at][hit] - items.place[entry]
    order = np.lexsort((begin, item, d))
    d, item, begin, rare = d[order], item[order], begin[order], items.rare[entry[order]]
    slack = np.array([max(4, len(x) // 4) for x in items.words])[item]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])])
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(d)) - 1
    seeded = np.logical_or.reduceat(rare, cut)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b, sure in zip(cut.tolist(), last.tolist(), seeded.tolist()):
        x = items.words[item[a]]
        lo, hi = int(w.first[d[a]]), int(w.first[d[a] + 1])
        p, q = max(lo, int(begin[a] - slack[a])), min(hi, int(begin[b] + len(x) + slack[a]))
        window = h[p:q]
        enough = least if len(x) >= SHORTEST else 1.0
        if not sure and not possible(x, window, enough):
            continue
        best, end = align(x, window)
        score = best / (2 * len(x))
        key = (int(d[a]), int(item[a]))
        if score >= enough and score > found.get(key, (0,))[0]:
            _, back = align(x[::-1], window[:end][::-1])
            found[key] = (score, p - lo + end - back, p - lo + end - 1)
    return [(dd, i, *v) for (dd, i), v in sorted(found.items())]


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.distinct), np.int64)
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                w, h = _words(c)
                g, doc, _ = seeds(h, w.first)
                at, k = items.find(g)
                if at.size:
                    pair = np.unique(doc[at] * len(total) + k)
                    total += np.bincount(pair % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "df"])

    return run


def blocks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size, with their rare grams told over all of docs."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(words) // (6 * BLOCK)))
    for i in range(n):
        rows = b.where(F.pmod(F.xxhash64("text"), n) == i).collect()
        items = Items([r[0] for r in rows], [r[1] for r in rows])
        if not items.ids:
            continue
        counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tv.tidy(_count(items)), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
        df = np.zeros(len(items.distinct), np.int64)
        df[counts["gram"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
        yield items.seeded(df)


FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"


def _report(items: Items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for c in tv.chunks(batch.column(1)):
                rows += [(ids[c.lo + d].as_py(), items.ids[i], s, a, b) for d, i, s, a, b in leaks(items, least, c)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, item_id, score (share of a full match), first_word, last_word (places of the leak in
    the document): a row for each document and item that it leaks."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for items in blocks(docs, benchmark, text):
        out = out.unionByName(d.mapInArrow(tv.tidy(_report(items, least)), FOUND))
    return out


def _clean(items: Items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = np.ones(batch.num_rows, bool)
            for c in tv.chunks(batch.column(at)):
                for d, *_ in leaks(items, least, c):
                    keep[c.lo + d] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    out = docs
    for items in blocks(docs, benchmark):
        out = out.mapInArrow(tv.tidy(_clean(items, least)), docs.schema)
    return out
