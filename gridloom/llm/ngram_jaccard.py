"""N-gram Jaccard join by PartEnum signatures.

A document is its set of distinct 5-word shingles (A-Z folded). Documents link when their Jaccard
similarity is at least 0.8. If |r| and |s| are set sizes and H the size of the symmetric
difference, a link means H <= (|r| + |s|) / 9, hence H <= |r| / 4 =: k(r) seen from either side.

Signatures: the shingle domain (64-bit hashes) is cut into n partitions, n fixed for a band of set
sizes. What a set holds in one partition is that partition's projection. Two linked sets differ in
at most H projections, so under any common order of the projections they share

* a subset of two among the first k + 2 projections of each, all of them being enumerated, where
  sets have less than 64 shingles, and
* a subset of one among the first k + 1 projections of each, where they have more: enumerating larger
  subsets would cost (k + 2)(k + 1) / 2 signatures a set there.

A set with fewer projections than that gives the band's one "sparse" signature as well, so no link
is lost. Sets within a quarter below a band's border also sign for the band above. The order puts
projections last that hold shingles which many documents share (bounded table of heavy hitters,
HOT entries, found by counting in every split), so that shared passages don't gather candidates.
The order is for cost only: whatever the table holds, the result is exact.

Documents with equal sets are one node. A signature's run is compared with its hub only; verified
links become components, and nodes of a run are looked at again just where they lie in different
components and what is known of both and the hub leaves a link possible: they share a shingle that the
hub lacks (which makes a finer run), or their sizes and overlaps with the hub allow it (see `_beside`),
or the hub is far from them (then the run goes on without it, see `_settle`). So the work on a group of
near copies grows with the group, and yet every pair that could join two components is either verified
on its whole texts or ruled out by an exact bound.

Hash identity: shingles and sets are told apart by 64-bit hashes.

Defined cases: null or empty text, or one without words: empty set, linked with nothing, own
component. Fewer than 5 words: one shingle, the whole sequence. Repeated rows: each is returned.
Null doc_id: such a row takes part; its component is the smallest doc_id of its group, or null.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import textvec as tv
from .graph import components, light, sized

WORDS = 5
#: Heavy hitters that the order knows of, at most.
HOT = 1 << 17
#: A shingle counts towards them where at least so many documents of one stretch of a split share it.
LOCAL = 3
#: Shingles counted together.
STRETCH = 1 << 21
BORDERS = (64, 256, 1024, 4096, 16384, 65536, 1 << 18, 1 << 20, 1 << 22)
#: Sets already signed for that a task remembers, so that it signs for copies once.
SEEN = 200_000
#: Members of a hub that are compared in one task.
STAR = 128

#: Hub rounds on runs before what is left of them is paired.
ROUNDS = 4

#: What comparing a with b tells: sizes, intersection, and the shingles of b that a lacks.
COMPARED = "a long, b long, na long, nb long, inter long, added array<long>"

U = np.uint64


def _shingles(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    w = tv.Words(c)
    h, doc, _ = tv.grams(w.hashes(), w.first, WORDS)
    return tv.sets(h, doc, c.n)


def _nodes(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; that of the empty set is 0."""
    size = np.diff(first)
    s = tv.mix(tv.per_doc(tv.mix(e, 31), first) + size.astype(U) * U(0x9E3779B97F4A7C15), 37)
    s[size == 0] = 0
    return s


def _cells(e: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A parity map of each set: a bit for each of at least twice as many cells as it has shingles,
    1 where an odd number of them falls into the cell."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = max(8, 2 << (b - a - 1).bit_length()) if b > a else 8
        odd = np.bincount((e[a:b] & U(n - 1)).astype(np.int64), minlength=n) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def _possible(slack: int):
    """Of rows (a, b, na, nb, cells of a, cells of b, keys ka and kb) those whose parity maps allow H <= slack *
    (na + nb) / 9: a cell of unlike parities holds a shingle that differs, whatever the sides share
    there. A link needs slack 1, a similarity of 0.5 slack 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                k = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, k), axis=0) for v in (x, y))
                keep.append(9 * int(np.bitwise_count(x ^ y).sum()) <= slack * (na + nb))
            yield batch.select(["a", "b", "ka", "kb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: key, size and node; besides, shingles that several documents share, with counts."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("cells", pa.binary())])
    held: list[np.ndarray] = []

    def heavy() -> Iterator[pa.RecordBatch]:
        v = np.concatenate(held) if held else np.zeros(0, U)
        held.clear()
        if len(v):
            v.sort()
            cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            count = np.diff(cut, append=len(v))
            keep = count >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(keep.sum(), np.int32)), pa.nulls(int(keep.sum()), pa.int64()), pa.array(count[keep].astype(np.int64)), pa.array(v[cut][keep].view(np.int64)), pa.nulls(int(keep.sum()), pa.binary())], schema=schema)

    total = 0
    for batch in batches:
        ids = batch.column(0)
        for c in tv.chunks(batch.column(1)):
            e, first = _shingles(c)
            node = _nodes(e, first)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(c.n, np.int32)), ids.slice(c.lo, c.n), pa.array(np.diff(first)), pa.array(node.view(np.int64)), pa.array(_cells(e, first), pa.binary())], schema=schema)
            held.append(e)
            total += len(e)
            if total >= STRETCH:
                yield from heavy()
                total = 0
    yield from heavy()


class Signer:
    def __init__(self, hot: np.ndarray, weight: np.ndarray):
        """hot: ascending shingle hashes; weight: 1 to 63, larger for more frequent ones."""
        self.hot, self.weight = hot, weight
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hot >> U(44)).astype(np.int64)] = True

    def weights(self, e: np.ndarray) -> np.ndarray:
        w = np.zeros(len(e), np.uint8)
        if len(self.hot):
            at = np.flatnonzero(self.maybe[(e >> U(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.hot, e[at]), len(self.hot) - 1)
            same = self.hot[found] == e[at]
            w[at[same]] = self.weight[found[same]]
        return w

    def sign(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, document of each) of sets whose shingles ascend within each document."""
        size = np.diff(first)
        band = np.searchsorted(BORDERS, size, side="right")
        above = np.minimum(band, len(BORDERS) - 1)
        both = (size >= 4) & (band < len(BORDERS)) & (size * 5 >= np.asarray(BORDERS)[above] * 4)
        weight = self.weights(e)
        sig, doc = [], []
        for pick, shift in ((size >= 4, 0), (both, 1)):
            docs = np.flatnonzero(pick)
            if docs.size == 0:
                continue
            b = band[docs] + shift
            s, d = self._band(e, weight, first, docs, b)
            sig.append(s)
            doc.append(d)
        if not sig:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return np.concatenate(sig), np.concatenate(doc)

    def _band(self, e, weight, first, docs, band):
        size = np.diff(first)[docs]
        low = np.concatenate([BORDERS[:1], BORDERS])[band]
        bits = np.minimum(62, np.log2(low).astype(np.int64) + 3)  # 8 partitions for each shingle of the band's least set
        each = np.repeat(np.arange(len(docs)), size)
        at = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1][docs], size)
        v, part = e[at], e[at] >> (64 - bits).astype(U)[each]
        cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (each[1:] != each[:-1])]))
        own = each[cut]
        name = tv.mix(np.add.reduceat(tv.mix(v, 41), cut) + band.astype(U)[own] * U(0xD1B54A32D192ED03), 43)
        order = (np.minimum.reduceat(weight[at], cut).astype(U) << U(57)) | (name >> U(7))
        begin = np.searchsorted(own, np.arange(len(docs) + 1)).tolist()
        sig, doc = [], []
        for i, (k, b) in enumerate(zip((size // 4).tolist(), band.tolist())):
            lo, hi = begin[i], begin[i + 1]
            need = k + 1 if b else k + 2
            names = name[lo:hi]
            if hi - lo > need:
                names = names[np.argpartition(order[lo:hi], need - 1)[:need]]
            if b == 0:
                names = np.sort(names)
                x, y = np.triu_indices(len(names), 1)
                names = tv.mix(names[x] * U(3) + names[y], 47)
            if hi - lo < need:
                names = np.append(names, tv.mix(np.array([b], U), 53))
            sig.append(names)
            doc.append(np.full(len(names), docs[i]))
        return np.concatenate(sig), np.concatenate(doc)


def _signatures(hot: np.ndarray, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(hot, weight), set()
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                e, first = _shingles(c)
                node = _nodes(e, first)
                fresh = []
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        fresh.append(i)
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(x)
                size = np.diff(first)
                keep = np.zeros(c.n, bool)
                keep[fresh] = True
                if len(fresh) < c.n:
                    e = e[np.repeat(keep, size)]
                    first = np.concatenate([[0], np.cumsum(np.where(keep, size, 0))])
                sig, doc = signer.sign(e, first)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[doc].view(np.int64))], names=["sig", "node"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text still has the set that the node column names."""
    for batch in batches:
        for c in tv.chunks(batch.column(1)):
            node = _nodes(*_shingles(c)).view(np.int64)
            part = batch.slice(c.lo, c.n)
            yield part.filter(pa.array(node == part.column(0).to_numpy(zero_copy_only=False)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, text), each hub's own first (b null): what COMPARED lists."""
    hub, e0 = None, None
    for batch in batches:
        a, part, b = (batch.column(i).to_pylist() for i in range(3))
        got = []
        for c in tv.chunks(batch.column(3)):
            e, first = _shingles(c)
            for i in range(c.n):
                row = c.lo + i
                s = e[first[i] : first[i + 1]]
                if b[row] is None:
                    hub, e0 = (a[row], part[row]), s.copy()
                elif hub == (a[row], part[row]):
                    both = np.concatenate([e0, s])
                    by = np.argsort(both, kind="stable")
                    ordered = both[by]
                    same = np.zeros(len(both) + 1, bool)
                    same[1:-1] = ordered[1:] == ordered[:-1]
                    more = ~(same[1:] | same[:-1]) & (by >= len(e0))
                    got.append((a[row], b[row], len(e0), len(s), int(same.sum()), ordered[more].view(np.int64)))
        *numbers, added = zip(*got) if got else [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(added, pa.list_(pa.int64()))], names=[f.split()[0] for f in COMPARED.split(", ")])


def _compared(pairs: DataFrame, count: int, nodes: DataFrame, rows: DataFrame, slack: int = 1) -> tuple[DataFrame, int]:
    """Of distinct pairs (a, b) of nodes, `count` of them, those that parity maps leave possible, with what
    comparing their whole texts tells, and linked; and how many these are."""
    side = nodes.select("node", "key", "n", "cells")
    few = light(pairs, count)
    one, two = side.toDF("a", "ka", "na", "ca").join(few, "a"), side.toDF("b", "kb", "nb", "cb").join(few, "b")
    maps = one.join(two, ["a", "b"]).select("a", "b", "na", "nb", "ca", "cb", "ka", "kb")
    pairs, count, _ = sized(maps.mapInArrow(tv.tidy(_possible(slack)), "a long, b long, ka long, kb long"), "possible")
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ka").alias("key")), F.struct(F.col("b").alias("node"), F.col("kb").alias("key"))))
    wanted = light(pairs.select(both.alias("x")).select("x.key", "x.node").distinct(), 2 * count)
    texts = rows.join(wanted, "key").select("node", "text").mapInArrow(tv.tidy(_texts), "node long, text string")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    pairs = pairs.select("a", "b")
    degree, hubs, _ = sized(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")), "degrees")
    members = pairs.join(light(degree, hubs), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = texts.withColumnRenamed("node", "b").join(light(members, count), "b").select("a", "part", "b", "text")
    starts = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    starts = texts.withColumnRenamed("node", "a").join(light(starts, count), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    laid = members.unionByName(starts).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = laid.mapInArrow(tv.tidy(_compare), COMPARED)
    return sized(found.withColumn("linked", F.expr("100 * inter >= 80 * (na + nb - inter)")), "compared")[:2]


#: What is known of a node in a run: its size, in how many of the first runs it is, its component so far.
MEMBER = ("sig", "node", "n", "runs", "component")


def _spokes(runs: DataFrame) -> tuple[DataFrame, int]:
    """Of runs (MEMBER) those with nodes of several components, and of runs of the same nodes one: each node
    but the run's hub, with hub, nc and hc (the hub's size and component); and how many rows these are.
    The hub is the node of most runs: of near copies, the one that the others were made from."""
    per = runs.groupBy("sig").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("c"),
        F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("i"), F.max(F.struct("runs", "node", "n", "component")).alias("top"),
    )
    once = per.where("x <> y").groupBy("c", "h", "i").agg(F.min(F.struct("sig", "top")).alias("s"))
    hubs, count, _ = sized(once.select("s.sig", F.col("s.top.node").alias("hub"), F.col("s.top.n").alias("nc"), F.col("s.top.component").alias("hc")), "hubs")
    return sized(runs.join(light(hubs, count), "sig").where("node <> hub"), "spokes")[:2]


def _beside(near: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where two nodes u and v that were compared with one hub, and lie in different components, can
    link: (runs of those that share a shingle which the hub lacks, pairs of others).

    near: hub, nc, node, n, runs, component, inter. With A what a node has besides the hub and L what
    it lacks of it, a link means 9 H <= n(u) + n(v). Where A(u) and A(v) have nothing in common,
    H >= |A(u)| + |A(v)| + ||L(u)| - |L(v)||, hence 9 (|A(u)| + |L(u)|) - n(u) <= 9 n(hub) - 8 n(v)."""
    linked, g, f = F.expr("100 * inter >= 80 * (n + nc - inter)"), F.expr("9 * (n + nc - 2 * inter) - n"), F.expr("9 * nc - 8 * n")
    near = near.withColumns({"linked": linked, "g": g, "f": f})
    bound = near.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.when(~F.col("linked"), F.col("g"))).alias("least"), F.max("f").alias("most"))
    bound, hubs, _ = sized(bound.where("x <> y").select("hub", "least", "most"), "groups")
    near, count, _ = sized(near.join(light(bound, hubs), "hub"), "near")
    added = stars.select(F.col("a").alias("hub"), F.col("b").alias("node"), "added").join(light(near.select("hub", "node", "n", "runs", "component"), count), ["hub", "node"])
    shared = added.select(F.explode("added").alias("e"), "hub", "node", "n", "runs", "component").withColumn("sig", F.xxhash64("hub", "e")).select(*MEMBER)
    m = near.select("hub", "node", "n", "component", "linked", "g", "f", "least", "most", (F.col("n") - F.col("inter")).alias("a"), (F.col("nc") - F.col("inter")).alias("l"))
    u, v = m.where("not linked and g <= most").alias("u"), m.where("f >= least").alias("v")
    # of two nodes in different components one at least isn't linked with the hub
    meet = u.join(v, F.expr("u.hub = v.hub and u.component <> v.component and u.node <> v.node and u.g <= v.f and v.g <= u.f and 9 * (u.a + v.a + abs(u.l - v.l)) <= u.n + v.n and (v.linked or u.node < v.node)"))
    return shared, meet.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b"))


def _settle(runs: DataFrame, nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) of the nodes that link with others, and how many; runs: (sig, node), of two
    nodes or more each.

    A round compares each run's nodes with its hub alone. Nodes that share less than half with it are a
    run of their own in the next round, with those others that the triangle inequality leaves them, split
    by bands of sizes; of nodes compared with one hub `_beside` tells which can link. Later rounds go on
    with what a run has besides its hub. After ROUNDS what is left of the runs is paired."""
    degree = runs.groupBy("node").agg(F.count(F.lit(1)).alias("runs")).join(nodes.select("node", "n"), "node")
    runs = runs.join(degree, "node").withColumn("component", F.col("node")).select(*MEMBER)
    empty = nodes.sparkSession.createDataFrame([], "a long, b long")
    links, pairs = empty, empty
    for turn in range(ROUNDS):
        spokes, count = _spokes(stored(runs, "members") if turn < 2 else runs)
        if not count:
            runs = runs.limit(0)
            break
        # less than half in common by size alone needs no look
        near, size, _ = sized(spokes.where("2 * least(n, nc) >= greatest(n, nc)").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        stars, size = _compared(near, size, nodes, rows, slack=3)
        links = links.unionByName(stars.where("linked").select("a", "b"))
        seen = stars.select(F.col("a").alias("hub"), F.col("b").alias("node"), "inter", "linked")
        left = spokes.join(light(seen, size), ["hub", "node"], "left")
        if turn:
            # linked nodes are of their hub's component
            runs = stored(left.withColumn("component", F.when(F.col("linked"), F.col("hc")).otherwise(F.col("component"))).select(*MEMBER), "left")
            continue
        comp, size = components(links)
        left = left.drop("component").join(light(comp, size), "node", "left").withColumn("component", F.coalesce("component", "node"))
        left = stored(left, "left")
        unsettled = left.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.col("inter").isNull()).alias("far"))
        unsettled, size, _ = sized(unsettled.where("x <> y").select("sig", "far"), "unsettled")
        left = left.join(light(unsettled, size), "sig")
        # a band of sizes and the next: nodes that link are of the same or of neighbouring bands
        band = F.floor(F.log("n") / math.log(1.26))
        far = left.where("far and (inter is null or 10 * inter < 7 * (n + nc - inter))").withColumn("band", F.explode(F.array(band, band + 1)))
        near = left.where("inter is not null").select("hub", "node", "nc", "n", "runs", "component", "inter").distinct()
        shared, meet = _beside(near, stars)
        runs = far.withColumn("sig", F.xxhash64("sig", "band")).select(*MEMBER).unionByName(shared)
        pairs = meet
    open_runs = runs.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    last = stored(runs.join(open_runs, "sig"), "last")
    meet = last.alias("l").join(last.alias("r"), F.expr("l.sig = r.sig and l.node < r.node and l.component <> r.component and 10 * least(l.n, r.n) >= 8 * greatest(l.n, r.n)"))
    pairs, count, _ = sized(pairs.unionByName(meet.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))).distinct(), "pairs")
    if count:
        links = links.unionByName(_compared(pairs, count, nodes, rows)[0].where("linked").select("a", "b"))
    return components(links)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs; see the module."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = plain.select(F.coalesce("id", F.xxhash64("text")).alias("key"), "text")
    profile = stored(plain.mapInArrow(tv.tidy(_profile), "kind int, id long, n long, node long, cells binary"), "profile")
    sets = profile.where("kind = 0 and n > 0")
    # the key of one row that has the set; rows without a doc_id are found by their text
    nodes = sets.groupBy("node").agg(F.min("id").alias("key"), F.max("n").alias("n"), F.max("cells").alias("cells"))
    if sets.where("id is null").limit(1).count():
        named = nodes.where("key is not null")
        bare = plain.where("id is null").select(F.xxhash64("text").alias("key"), "text").mapInArrow(_named, "node long, key long").join(named, "node", "left_anti").groupBy("node").agg(F.min("key").alias("bare"))
        nodes = nodes.join(bare, "node", "left").select("node", F.coalesce("key", "bare").alias("key"), "n", "cells")
    nodes = stored(nodes, "nodes")

    top = profile.where("kind = 1").groupBy("node").agg(F.sum("n").alias("df")).orderBy(F.desc("df"), "node").limit(HOT).toPandas()
    hot = top["node"].to_numpy(np.int64).view(U)
    order = np.argsort(hot)
    weight = np.clip(np.log2(np.maximum(top["df"].to_numpy(np.float64), 2)) * 2, 1, 63).astype(np.uint8)[order]
    signed = rows.select("text").mapInArrow(tv.tidy(_signatures(hot[order], weight)), "sig long, node long")
    run = Window.partitionBy("sig")
    runs = signed.withColumn("x", F.min("node").over(run)).withColumn("y", F.max("node").over(run)).where("x <> y")
    comp, count = _settle(stored(runs.drop("x", "y").distinct(), "runs"), nodes, rows)
    # least ids of equal sets, then of components; nodes alone are named by their own
    least = sets.groupBy("node").agg(F.min("id").alias("least"))
    comp = light(comp, count)
    names = least.join(comp, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    member = least.join(comp, "node", "left").join(light(names, count), "component", "left").select("node", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = profile.where("kind = 0").join(member, "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key) of rows that have no id."""
    for batch in batches:
        for c in tv.chunks(batch.column(1)):
            node = _nodes(*_shingles(c)).view(np.int64)
            part = batch.slice(c.lo, c.n)
            yield pa.RecordBatch.from_arrays([pa.array(node), part.column(0)], names=["node", "key"])
