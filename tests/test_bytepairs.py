"""The core's byte-pair tokenizer against a plain merge and the public library."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bytepairs as bp
from gridloom.operators import tokens as tk
from gridloom.plans import catalog, training
from gridloom.sources import token_shards

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


def plain_merge(piece, ranks):
    part = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[part[i] + part[i + 1]], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in part]
        part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]


@pytest.fixture(scope="module")
def own():
    return bp.tokenizer("gpt-2", PATH)


def test_merges_equal_a_plain_loop(own):
    rng = random.Random(1)
    for _ in range(400):
        p = bytes(rng.choice(b"aabcdehinorst e\xc3\xa9\xff") for _ in range(rng.randrange(1, 60)))
        assert bp.merged(p, own.ranks) == plain_merge(p, own.ranks)
    small = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    for _ in range(400):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        assert bp.merged(p, small) == ([small[p]] if p in small else plain_merge(p, small))


@pytest.mark.parametrize("model", ["gpt-2", "llama-3"])
def test_ids_equal_the_library(model):
    import tiktoken

    t = bp.tokenizer(model, PATH)
    lib = tiktoken.Encoding("own", pat_str=bp.PATTERNS[model], mergeable_ranks=t.ranks, special_tokens=t.special)
    rng = random.Random(2)
    texts = ["", " ", "don't DON'T\r\n\r\n  x 12345", "<|endoftext|> and <|end_of_text|>"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), 0x4E00 + rng.randrange(99), 32, 10])) for _ in range(rng.randrange(150))) for _ in range(300)]
    for x in texts:
        assert t.encode(x) == lib.encode_ordinary(x)
        assert t.encode(x, allowed=list(t.special)) == lib.encode(x, allowed_special="all")
        assert t.decode(t.encode(x)) == x.encode()
    end = bp.END[model]
    assert t.encode("a", first=end, last=end) == [t.special[end], *t.encode("a"), t.special[end]]
    with pytest.raises(ValueError):
        t.encode(f"a {end}", refused=[end])
    assert t.size == len(t.ranks) + (1 if model == "gpt-2" else 256) and len(set(t.special.values())) == len(t.special)


def test_long_runs_are_cut(own):
    assert list(bp.stretches("aaaaa  b" + " " * 7, 100, 3)) == ["aaa", "aa  b   ", "   ", " "]
    assert list(bp.stretches("abcdefgh", 5, 9)) == ["abcde", "fgh"]
    assert "".join(bp.stretches("x" * 60_000 + " y")) == "x" * 60_000 + " y"
    assert max(map(len, bp.stretches("x" * 60_000))) == 25_000
    assert own.encode("ab" * 600_000)[:3] == own.encode("ab" * 12_500)[:3]  # and takes seconds


def test_documents_as_tokens_and_shards(spark, tmp_path):
    texts = ["the cat", None, "", "naïve  café", "the cat"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = bp.tokenizer("gpt-2", PATH)
    ids = bp.tokenised(d, "doc_id", "text", "gpt-2", PATH)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {i: [50256, *t.encode(x)] for i, x in enumerate(texts) if x is not None}
    back = {r.doc_id: bytes(r.bytes).decode() for r in bp.detokenised(ids, "doc_id", "ids", "gpt-2", PATH).collect()}
    assert back == {i: "<|endoftext|>" + x for i, x in enumerate(texts) if x is not None}
    flat = [x for i in sorted(got) for x in got[i]]
    uri = f"file://{tmp_path}/shards"
    assert sorted(token_shards.write_pieces(tk.shard_pieces(ids, "doc_id", "ids", 4), uri)) == [(i, min(4, len(flat) - 4 * i)) for i in range(-(-len(flat) // 4))]
    assert [r.tok for r in token_shards.read(spark, uri).orderBy("shard", "pos").collect()] == flat


def test_whole_tables_equal_the_library(spark):
    import tiktoken

    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect() if r.text is not None]
    want = {k: [50256, *lib.encode_ordinary(x)] for k, x in docs}
    got = catalog.queries()["tokenised_documents"](spark, sf).collect()
    assert {r.doc_id: (r.n, r.sum, r.n_bytes) for r in got} == {k: (len(want[k]), sum(want[k]), len(x.encode()) + 13) for k, x in docs}
    flat = [x for k, _ in docs for x in want[k]]
    shards = {r.shard: (r.n, r.sum) for r in catalog.queries()["tokenised_shards"](spark, sf).select("shard", "n", F.col("sum")).collect()}
    assert shards == {i: (len(flat[lo : lo + 100_000]), sum(flat[lo : lo + 100_000])) for i, lo in enumerate(range(0, len(flat), 100_000))}


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    for model in ("gpt-2", "llama-3"):
        t = bp.tokenizer(model, PATH)
        for _ in range(400):
            text = "".join(rng.choice([" ", " ", "a", "the", "\n", "\t", "12", "7", "'s", "é", "!", "\x1c", " ", "　"]) for _ in range(rng.randrange(25)))
            assert np.frombuffer(t.packed(text), "<i4").tolist() == t.encode(text), repr(text)
    assert len(bp.tokenizer("gpt-2", PATH).chunks) > 0


def test_workers_take_few_rows_at_once_and_refuse_unknown_ids(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["i"])
    assert [b.num_rows for b in bp._slices([batch])] == [256, 256, 256, 232]
    for wrong in ([1, 60_000], [-1]):
        with pytest.raises(Exception, match="id|ndex"):
            bp.detokenised(spark.createDataFrame([(1, wrong)], "k long, ids array<int>"), "k", "ids", "gpt-2", PATH).collect()


def test_ids_are_made_once_and_shards_are_read_together(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            made.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[x] * 3 for x in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["k", "ids"])

    ids = spark.range(40).mapInArrow(once, "k long, ids array<int>")
    uri = f"file://{tmp_path}/shards"
    token_shards.write_pieces(tk.shard_pieces(ids, "k", "ids", 4), uri)
    assert made.value == 40
    back = token_shards.read(spark, uri)
    assert back.rdd.getNumPartitions() == 1 and [r.tok for r in back.orderBy("shard", "pos").collect()] == [k for k in range(40) for _ in range(3)]


def test_pieces_hold_the_tokens_of_rows(spark):
    sf = "/root/testdata/sf0.001"
    p = training._pieces(spark, sf, 700).select("shard", "start", F.posexplode("ids").alias("i", "tok"))
    got = p.select("shard", (F.col("start") + F.col("i")).alias("pos"), F.col("tok").cast("long").alias("tok"))
    want = training._tokens(spark, sf, 700).select("shard", "pos", "tok")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()
