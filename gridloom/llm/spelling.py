r"""Spelling variants: words one edit apart, found by their three rarest q-grams.

Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased; of one
in DAMAGE (document, run) pairs, picked by crc32, one code point is lost. Words of at least `least`
code points and `often` occurrences count.

Rare-first prefix filter: bigrams are put into one global order by frequency, rarest first. An edit spoils
at most two bigrams of either word, and what it leaves keeps its order and moves by one place at most, so
the least bigram that both keep is among the three rarest of each (of equal bigrams the earlier is
rarer). Words are therefore joined on their three rarest bigrams, with places and lengths that differ by
one at most, and every candidate is verified by its edit distance. (Were frequencies counted by bigram
and place, a shift by one would change the order, and pairs would get lost.)

A bigram, place and length that more than HOT words share isn't paired: its words are joined on
their forms with one code point taken out instead, each with its place, and on those with a whole word,
where a key has no more words than the alphabet has letters. So no group is paired with itself,
and no pair is lost.

A word's form is its near word of largest n, if that has at least twice its own; forms of forms are
followed by doubling, so a chain of k takes log k joins; n doubles with each form, so k is below 64.

Defined cases: null texts give no words; a null doc_id is an empty string before the colon; repeated rows
count each; bytes that aren't UTF-8 end a run; other columns are ignored; an empty table gives an empty
result. A text has no length limit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: In UTF-8, U+00C0 to U+00FF are C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
DAMAGE = 97
#: Words whose counts a task holds before it hands them on.
HELD = 400_000
#: Words of one bigram, place and length that are paired at most.
HOT = 256
RAREST = 3


def _without(word: bytes, i: int) -> bytes:
    t = word.decode()
    return (t[:i] + t[i + 1 :]).encode()


def occurrences(key: int | None, text: bytes) -> Counter:
    """Lower-cased runs of a text with their counts, damaged where the hash says so."""
    found = Counter(RUN.findall(text.lower()))  # of bytes, only A-Z change
    start = zlib.crc32(b":" if key is None else b"%d:" % key)
    hit = [(w, h) for w in found if not (h := zlib.crc32(w, start)) % DAMAGE]
    hurt = Counter({w: found.pop(w) for w, _ in hit})
    for w, h in hit:
        found[_without(w, h % len(w.decode()))] += hurt[w]
    return found


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def taken() -> pa.RecordBatch:
            rows = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= least]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    for w, n in occurrences(key, text).items():
                        held[w] += n
                    if len(held) > HELD:
                        yield taken()
        yield taken()

    return run


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, often: int = 3) -> DataFrame:
    """(word, n): words of all documents with their occurrences, counted in the tasks first."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return d.mapInArrow(_counted(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _bigrams(w: Column) -> Column:
    """The bigrams of a word in order; none where it is too short."""
    return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _rarest(order: dict[str, int], q: int):
    """Of rows (word) the rarest bigrams with their places and the word's length."""
    last = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for w in batch.column(0).to_pylist():
                n = len(w)
                out += [(g, i, n, w) for g, i in sorted((order.get(w[i : i + 2], last), i) for i in range(n - 1))[:q]]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["gram", "pos", "len", "word"])

    return run


def near_pairs(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) of a stored table of distinct words: pairs one edit apart, each once with a before b or a
    the shorter."""
    # at most 90 letters, so 8,100 bigrams
    counted = vocabulary.select(F.explode(_bigrams(F.col("word"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    order = {r.g: i for i, r in enumerate(sorted(counted.collect(), key=lambda r: (r.n, r.g)))}
    signed = stored(vocabulary.select("word").mapInArrow(_rarest(order, RAREST), "gram int, pos int, len int, word string"), "spelling_signed")
    cell = ["gram", "pos", "len"]
    crowded = stored(signed.groupBy(*cell).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).drop("c"), "spelling_crowded")
    # a word looks for those of its own length and of one more, one place around its own
    around = F.explode(F.array(*[F.struct((F.col("pos") + i).alias("p"), (F.col("len") + k).alias("l")) for i in (-1, 0, 1) for k in (0, 1)])).alias("x")
    probe = signed.select("gram", F.col("word").alias("a"), "len", around).select("gram", F.col("x.p").alias("pos"), F.col("x.l").alias("len"), F.col("len").alias("own"), "a")
    calm = signed.join(crowded, cell, "left_anti").withColumnRenamed("word", "b")
    pairs = probe.join(calm, cell).where("len > own OR a < b").select("a", "b")
    found = pairs.where(F.levenshtein("a", "b", 1) == 1)
    # crowded cells: b is in one, and a looks there
    b = signed.join(crowded, cell, "left_semi").select(F.col("word").alias("b"), "len").distinct()
    a = probe.join(crowded, cell, "left_semi").select("a", F.col("own").alias("len")).distinct()
    place = lambda w: F.posexplode(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substr(w, i + 1)))).alias("i", "rest")
    b_cut = b.select("b", place(F.col("b")))
    same = a.select("a", place(F.col("a"))).join(b_cut, ["i", "rest"]).where("a < b").select("a", "b")
    longer = a.join(b_cut, F.col("a") == F.col("rest")).select("a", "b")
    return found.unionByName(same).unionByName(longer).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last that following forms leads to."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        at = stored(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if not at.where("moved").limit(1).count():
            return at.drop("moved")
        at = at.drop("moved")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, often: int = 3, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    v = stored(words(docs, key, text, least, often), "spelling_words")
    pairs = near_pairs(v, hot)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(v.select(F.col("word").alias("b"), "n"), "b")
    best = known.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("b").alias("form"))).alias("x"))
    own = stored(v.join(best.withColumnRenamed("a", "word"), "word", "left").withColumn("ok", F.coalesce(-F.col("x.m") >= 2 * F.col("n"), F.lit(False))).select(
        "word", F.when(F.col("ok"), F.col("x.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), -F.col("x.m")).alias("form_n")), "spelling_forms")
    roots = _roots(own.where("form IS NOT NULL"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
