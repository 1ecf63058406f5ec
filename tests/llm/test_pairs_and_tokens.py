"""Spelling variants, byte-level BPE and hard negatives against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import byte_bpe, hard_negatives, spelling

ODD = [None, "", " \n\t ", "one", "É è\x0bà\x0cÇ\r\nx y z", "a b c d e " * 3000, "ΑΒΓ " * 40, "x" * 5000, "don't  do\n\n that", "1234567   \x1c 12", "<|endoftext|> a", "\U0001f600 ́e"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_spelling(rows, least=5, often=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def spelled(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def variants():
    rng = random.Random(7)
    letters = "abcdeéßÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 11))) for _ in range(40)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([3, 20, 80])
        for _ in range(rng.randrange(8)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            pool += [v] * rng.choice([2, 3, 9])
    pool += ["chaine"] * 60 + ["chain"] * 20 + ["chann"] * 5
    pool += ["aaaaa"] * 9 + ["aaaaaa"] * 4 + ["aaaaaaa"] * 3 + ["ababab"] * 3 + ["bababa"] * 3
    rng.shuffle(pool)
    return [" ".join(pool[i : i + 40]) + rng.choice([".", "\n", " 7x"]) for i in range(0, len(pool), 40)]


@pytest.mark.parametrize("hot", [0, 2, 256])
def test_spelling_equals_brute_force(docs, variants, hot):
    texts = ODD + variants + [v.upper() for v in variants[:5]]
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(texts))]  # null and repeated ids
    got = spelled(spelling.group(docs(texts, ids), hot=hot))
    assert got == brute_spelling(zip(ids, texts))
    assert any(r[1] and r[1] != r[2] for r in got), got  # a chain of forms


def test_spelling_pairs_are_found_once(docs, variants, spark):
    v = spelling.stored(spelling.words(docs(variants)), "words")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(v, 3).collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs)


def test_spelling_damage_happens():
    key = next(k for k in range(10_000) if zlib.crc32(b"%d:stra\xc3\x9fe" % k) % 97 == 0)
    h = zlib.crc32(b"%d:stra\xc3\x9fe" % key)
    want = "straße"[: h % 6] + "straße"[h % 6 + 1 :]
    assert spelling.occurrences(key, "STRAße straße other".encode()) == Counter({want.encode(): 2, b"other": 1})


def test_spelling_of_nothing(docs):
    assert spelling.group(docs([])).collect() == []
    assert spelling.group(docs([None, "", "a b c"])).collect() == []


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    v = byte_bpe.vocabulary(*byte_bpe._args(None, None))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    point = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0x110000), rng.randrange(0x250), 97, 32, 10])
    return ["".join(map(chr, (point() for _ in range(rng.randrange(200))))).encode("utf-8", "replace").decode() for _ in range(n)]


def test_bpe_equals_the_library(docs, library):
    texts = ODD + random_texts(300, 3) + ["".join(random.Random(1).choice("abcdefgh") for _ in range(30_000)), "ab" * 2000, "y" * 256, "y" * 257]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    got = sorted(tuple(r) for r in byte_bpe.digests(docs(texts, ids)).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for i, t in zip(ids, texts):
        x = library.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_rounds_and_heap_merge_alike(library):
    v = byte_bpe.vocabulary(*byte_bpe._args(None, None))
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"aabcdehinrst\xc3\xa9 ") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    assert v.rounds(rows, 64) == [v.long(r) for r in rows]
    assert v.rounds([b"abc", b"a"], 3)[1] == v.rounds([b"a"], 1)[0]


def test_bpe_small_memory_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 5)
    monkeypatch.setattr(byte_bpe, "CELLS", 40)
    monkeypatch.setattr(byte_bpe, "STRETCH", 100)
    v = byte_bpe.Vocabulary(*byte_bpe._args(None, None))
    texts = random_texts(50, 9) + ["the cat sat on the mat ", " on the other hand", "a  b c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_decodes_ids_and_takes_empty_tables(docs):
    d = docs(["naïve café", None, ""])
    back = byte_bpe.decode(byte_bpe.encode(d))
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in back.collect()) == [(0, "naïve café"), (1, ""), (2, "")]
    assert byte_bpe.digests(docs([])).collect() == []
    assert byte_bpe.decode(byte_bpe.encode(d).withColumn("ids", F.lit(None).cast("array<int>"))).collect()[0].bytes is None


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("rank", T.IntegerType())])


def brute_negatives(rows, every=4, positives=5, negatives=10):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * x)) for x in v], label))
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for p, (i, v, label) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, m == label, q) for q, (j, w, m) in enumerate(kept) if q != p)
        for s, j, _, _ in [x for x in scored if x[2]][:positives]:
            far = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(far)]
    return sorted(out)


def vectors(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    return [(i, [float(x) for x in scale * (centres[i % 4] + rng.normal(size=d))], int(rng.integers(0, 4))) for i in range(n)]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, lambda i: i % 4 == 0, **more).collect())


def test_negatives_equal_brute_force(spark):
    rows = vectors(150, 12, 1)
    rows += [(4, rows[4][1], rows[4][2])] * 2  # repeated rows, one of which is an anchor
    rows += [(200 + i, rows[8][1], i % 3) for i in range(30)]  # ties, of which every fourth is an anchor
    rows += [(None, rows[0][1], 1), (300, None, 1), (304, rows[0][1], None), (308, [1.0, None], 1), (312, [float("nan")], 1), (316, [float("inf")], 2), (320, [], 1), (324, [0.5, 0.25], 1), (328, [0.0] * 12, 2)]
    want = brute_negatives(rows)
    assert len(want) > 1000
    assert mined(spark, rows) == want
    assert mined(spark, rows, block=7) == want


def test_negatives_of_large_numbers(spark):
    for scale in (2.0**22, 2.0**30):  # beyond exact doubles, beyond 64 bits
        rows = vectors(30, 6, 2, scale)
        assert mined(spark, rows) == brute_negatives(rows)


def test_bounds_rule_pairs_out(monkeypatch):
    """Leading axes discard most pairs where rows lie along a few of them, and lose none that matters."""
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    x = np.floor(256 * (rng.normal(size=(4000, 3)) @ base[:3] + 0.01 * rng.normal(size=(4000, 32))))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    low = np.full((5, 1), -hard_negatives.MOST)
    task = hard_negatives.Task(hard_negatives.Block(np.arange(5), np.zeros(5, int), x[:5], True, 6, low, -low), axes)
    asked = []
    exact = task.exact
    monkeypatch.setattr(task, "exact", lambda x, r, k: asked.append(len(r)) or exact(x, r, k))
    for i in range(0, 4000, 500):
        task.strip(np.arange(i, i + 500), np.zeros(500, int), x[i : i + 500])
    assert sum(asked[1:]) < 0.05 * 5 * 3500
    assert task.score.reshape(5, 6).tolist() == (-np.sort(-(x[:5] @ x.T), axis=1)[:, :6]).astype(int).tolist()


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1)]) == []
    assert mined(spark, [(4, [0.5], 1)]) == []
