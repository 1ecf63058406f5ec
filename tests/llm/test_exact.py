"""Operators whose results are exact, against brute force and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import decontaminate, graph, line_rules, ngram_jaccard, packing, secret_links, sharding, textvec, warc

WORDS = [f"w{i}" for i in range(400)]
#: Line rules read any number as 0, so their lines are told apart by letters.
LETTERS = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(400)]
ODD = [None, "", " \n\t ", "one", "one two three four", "one two three four", "É è\x0bà\x0cÇ\r\nx y z", "a b c d e " * 9000, "ΑΒΓ " * 40]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        least[root(i)].append(k)
    return [(k, len(s), (min((x for x in least[root(i)] if x is not None), default=None) if s else k)) for i, (k, s) in enumerate(zip(ids, sets))]


def near_copies(seed, n_bases, copies):
    rng = random.Random(seed)
    out = []
    for _ in range(n_bases):
        base = [rng.choice(WORDS) for _ in range(rng.choice([5, 9, 14, 17, 40, 70, 150, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.2:
                w = w[rng.randrange(3) :]
            out.append(" ".join(w))
    return out


def test_words_are_those_of_the_rule():
    texts = pa.array(["A b\x0bC d ", None, "", "x", " é  É\n"])
    for c in textvec.chunks(texts, 4):
        w = textvec.Words(c)
        for d in range(c.n):
            raw = (texts[c.lo + d].as_py() or "").encode()
            got = [bytes(c.bytes[s:e]) for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])]
            assert got == raw.split()


def test_jaccard_join_loses_no_link(docs):
    texts = near_copies(1, 14, 9) + ODD[:-2]
    ids = list(range(1000, 1000 + len(texts)))
    got = [tuple(r) for r in ngram_jaccard.link(docs(texts, ids)).collect()]
    assert sorted(got) == sorted(brute_components(texts, ids))


def test_jaccard_join_shuffles_where_it_may_not_broadcast(docs, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    texts = near_copies(7, 8, 6)
    ids = list(range(len(texts)))
    assert sorted(tuple(r) for r in ngram_jaccard.link(docs(texts, ids)).collect()) == sorted(brute_components(texts, ids))


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_groups_around_a_hub_lose_no_link(docs, monkeypatch, rounds):
    """Copies edited so far that many miss the hub by little, with edits in common, cuts and other sizes."""
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", rounds)
    rng = random.Random(21)
    base, passage = [rng.choice(WORDS) for _ in range(160)], [rng.choice(WORDS) for _ in range(30)]
    texts = [" ".join(base)] * 2
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS[:5] if i % 3 else WORDS)
        if i % 4 == 1:
            w = w[: rng.randrange(90, 160)]
        if i % 4 == 2:
            w += passage[: rng.randrange(5, 30)]
        if i % 10 == 3:
            w = w[:70] + [rng.choice(WORDS) for _ in range(90)]
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    assert sorted(tuple(r) for r in ngram_jaccard.link(docs(texts, ids)).collect()) == sorted(brute_components(texts, ids))


def test_components_of_chains_and_stars(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 150), (150, 200)] + [(300 + i, 300 + i // 2) for i in range(1, 50)]
    want = {n: 0 for n in range(41)} | {n: 100 for n in range(100, 160)} | {150: 100, 200: 100} | {n: 300 for n in range(300, 350)}
    for small in (0, 500_000):
        monkeypatch.setattr(graph, "SMALL", small)
        got, count = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.component for r in got.collect()} == want and count == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long"))[1] == 0


def test_jaccard_join_without_ids_and_repeated(docs):
    base = " ".join(WORDS[:30])
    got = sorted((tuple(r) for r in ngram_jaccard.link(docs([base, base, base + " z", None, base], [None, 7, 3, None, 7])).collect()), key=repr)
    assert got == sorted([(None, 26, 3), (7, 26, 3), (3, 27, 3), (None, 0, None), (7, 26, 3)], key=repr)
    lone = ngram_jaccard.link(docs([base, base + " z"], [None, None])).collect()
    assert [r.component_id for r in lone] == [None, None]


def test_jaccard_join_of_nothing(docs):
    assert ngram_jaccard.link(docs([])).count() == 0


def test_signatures_share_one_at_every_size():
    rng = np.random.default_rng(3)
    signer = ngram_jaccard.Signer(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    for size in [*range(4, 30), 50, 63, 64, 65, 120, 255, 256, 700]:
        for _ in range(6):
            r = rng.integers(0, 2**64, size, np.uint64)
            lost = size // 9  # of equal sets' 2 / 9
            s = np.concatenate([r[lost:], rng.integers(0, 2**64, lost, np.uint64)])
            for other in (s, r[: -(-size * 4 // 5)]):
                e = np.concatenate([np.sort(r), np.sort(other)])
                sig, doc = signer.sign(e, np.array([0, size, size + len(other)]))
                assert set(sig[doc == 0]) & set(sig[doc == 1]), size


def brute_rules(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_line_rules(docs):
    texts = [*ODD, "a b c a b c a b c", "x #y\nx #y\n\nx #y", *("shared footer line\nown " + " ".join(LETTERS[i : i + 60]) for i in range(12)), *("all of it is shared by a dozen documents " * 7 + "\nno more",) * 12]
    got = line_rules.apply(docs(texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert tuple(r)[1:6] == brute_rules(t), t and t[:40]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    own = got[len(ODD) + 2 : len(ODD) + 14]
    assert all(r.kept and r.removed_words == 3 for r in own)
    assert line_rules.apply(docs([])).count() == 0


def line_rules_against_sql(spark, rows, tmp_path):
    import duckdb

    from gridloom.llm import registry

    d = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, t string, h string, words string, host string")
    got = line_rules.apply(d).toPandas()
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(registry.oracle_sql()["op4_line_frequency"]).df()
    return got, want


def test_line_rules_equal_their_sql(spark, tmp_path):
    """Null and empty hosts apart, repeated rows one document, texts under many ids, clashing names."""
    line = "a line that some share " * 12
    own = lambda i: " ".join(LETTERS[i : i + 60])
    extra = (1, "t", "h", "w", "host")
    rows = [(i, f"{line}\n{own(i)}", None if i % 2 else "", *extra) for i in range(12)]  # six of each
    rows += [(100, f"only one document\n{own(30)}", "s", *extra)] * 12
    rows += [(200 + i, f"shared by twelve\n{own(40 + i)}", "s", *extra) for i in range(12)]
    rows += [(300 + i, f"twelve of no host\n{own(60 + i)}", None, *extra) for i in range(12)] + [(400, None, None, *extra), (401, "", "", *extra)]
    got, want = line_rules_against_sql(spark, rows, tmp_path)
    key = ["doc_id", "n_words"]
    a = got.drop_duplicates().sort_values(key).reset_index(drop=True)
    b = want.drop_duplicates().sort_values(key).reset_index(drop=True)[list(a.columns)]
    assert a.astype(str).to_csv() == b.astype(str).to_csv()
    removed = got.set_index("doc_id")["removed_words"].sort_index()
    assert (removed.loc[:11] == 0).all() and (removed.loc[100] == 0).all() and (removed.loc[200:211] == 3).all() and (removed.loc[300:311] == 4).all()


def test_windows_that_share_a_hash(docs, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (3, 4, 9, 30, 200, 900)] + ["a b c d a b c", "x y z", ""]
    for bits in (64, 6, 1):
        monkeypatch.setattr(line_rules, "HASH", bits)
        for r, t in zip(line_rules.apply(docs(texts)).orderBy("doc_id").collect(), texts):
            assert tuple(r)[1:6] == brute_rules(t), (bits, t[:40])


def test_frequent_lines_leave_the_texts(docs):
    own = lambda i: " ".join(LETTERS[i : i + 60])
    texts = [f"Shared Footer 7\n{own(i)}\n\nshared footer 88 " for i in range(12)] + [own(80), None, " ".join(LETTERS[:80]) + "\nmore"] + [" ".join(LETTERS[:80])] * 11
    d = docs(texts)
    got = {r.doc_id: r for r in line_rules.clean(d).collect()}
    kept = {r.doc_id for r in line_rules.apply(d).collect() if r.kept}
    assert set(got) == kept == set(range(13)) and line_rules.clean(d).columns == d.columns
    assert all(got[i].text == f"{own(i)}\n" for i in range(12)) and got[12].text == texts[12]
    assert line_rules.clean(docs([])).count() == 0


def test_depleted_documents_are_rejected(docs):
    shared = " ".join(LETTERS[:80])
    got = line_rules.apply(docs([shared] * 11 + [" ".join(LETTERS[100:180])])).orderBy("doc_id").collect()
    assert not any(r.kept or r.base_failed for r in got[:11]) and got[11].kept


def test_shards_fit_and_split_only_where_needed(docs):
    rng = random.Random(5)
    texts = ["x" * rng.randrange(0, 400) for _ in range(300)] + [None, ""]
    got = sharding.assign(docs(texts), limit=2000).collect()
    assert len(got) == len(texts)
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16), "048b") for i in range(len(texts))}
    size = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    for r in got:
        assert r.n_bytes == size[r.doc_id] and bits[r.doc_id].startswith(r.shard) and len(r.shard) == r.depth and r.page == 0
        total = lambda p: sum(size[i] for i in bits if bits[i].startswith(p))
        assert total(r.shard) == r.shard_bytes <= 2000
        assert not r.shard or total(r.shard[:-1]) > 2000


def test_shards_of_one_key(docs):
    got = sharding.assign(docs(["x" * 300] * 40 + ["y" * 5000], [1] * 41), limit=1000).collect()
    pages = defaultdict(int)
    for r in got:
        pages[r.page] += r.n_bytes
    assert len(got) == 41 and sum(r.oversized for r in got) == 1 and sorted(pages.values())[-2] <= 1000
    assert sharding.assign(docs([])).count() == 0


def test_secret_spans(docs):
    k = "AKIA" + "Q7" * 9
    texts = [*ODD, f"é token = '{'a1' * 20}' and {k}", 'API-KEY: x api_key="short" PassWd:longenough1', "ff" * 12 + " " + "0" * 23, f"user=alice http://10.0.0.1:80/x {'aB3' * 12} {k}", f"{'aB3' * 12} alone"]
    for r, text in zip(secret_links.scan(docs(texts)).orderBy("doc_id").collect(), texts):
        spans = []
        for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
        base = [s for _, _, s in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(filter(None, r.spans.split(",")))
    assert "endpoint" in secret_links.written(secret_links.spans(texts[-2])[1]) and secret_links.spans(texts[-1])[1] == []
    red = secret_links.redact(docs(texts)).orderBy("doc_id").collect()
    assert k not in red[-5].text and red[0].text is None and red[-1].text == texts[-1]


def test_weak_secret_parts_link_each_other():
    key = "aB3/" * 10
    kinds = lambda text: [k for _, _, k in secret_links.spans(text)[1]]
    three = f"client_id: billing-svc\nhttps://db.internal.example.com:5432/x\n{key}"
    assert kinds(three) == ["ident", "endpoint", "blob"]
    short = "user=bob password=abc12 host db.example.com:5432"
    assert secret_links.written(secret_links.spans(short)[1]) == "ident:0:8,blob:18:23,endpoint:29:48"
    assert kinds("user=bob password=abc12") == kinds("password=abc12 db.example.com:5432") == kinds(f"user=bob {key}") == []
    assert kinds(three.replace("\n", "\n\n")) == [] and kinds(three.replace("\n", " " * 201)) == []


def brute_links(text, reach=secret_links.REACH):
    """The weak spans that stay, by looking at every pair of parts."""
    base = secret_links.base_spans(text)
    weak = secret_links._weak(text, base)
    cuts = [m.start() for m in secret_links.SCOPE.finditer(text)]
    out = []
    for s, e, k in weak:
        before, after = [c for c in cuts if c <= s], [c for c in cuts if c > s]
        low, high = max(before[-1] if before else 0, s - reach), min(after[0] if after else len(text), e + reach)
        near = [(secret_links.ROLE[x], x) for a, b, x in base + weak if secret_links.ROLE[x] != secret_links.ROLE[k] and a < high and b > low]
        if len({r for r, _ in near}) == 2 or k == "blob" and any(x == "access" for _, x in near):
            out.append((s, e, k))
    return out


def test_linked_spans_are_those_of_all_pairs():
    rng = random.Random(13)
    parts = ["user=bob", "client_id: " + "x" * 300, "https://h.example.com/" + "p" * 250, "db.example.com:5432", "aB3/" * 10, "password=abc", "token=longenough1", "AKIA" + "Q7" * 9, "ff" * 14, "\n\n", "plain words", "é" * 30, "z" * 180, "10.0.0.1"]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        base = secret_links.base_spans(text)
        assert secret_links.linked(text, base) == brute_links(text), text


def test_secrets_of_long_texts_and_repeated_rows(docs):
    import time

    long = "user=" + "n" * 300 + " token=secretsecret db.example.com:5432"
    assert secret_links.spans(long)[1][0] == (0, 305, "ident")
    assert "n" not in secret_links.redact(docs([long])).first().text.replace("token", "")
    many = "https://h.example.com/" + "p" * 200_000 + " " + "user=bob password=abc12 x.example.com:80 " * 40_000
    began = time.perf_counter()
    assert len(secret_links.spans(many)[1]) > 100_000 and time.perf_counter() - began < 30
    got = secret_links.scan(docs([long, long, None], [1, 1, None])).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2].spans == ""


def test_packing_is_a_partition_of_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "a  b \n c", " lead", "trail ", "  x  y", "<|endoftext|> z", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", *near_copies(2, 8, 3)]
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]
    rows = packing.pack(docs(texts)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, own in pieces.items():
        assert [s for s, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) == len(ids[d])
    assert len(pieces) == len(texts)
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
        n = sum(x for _, x in own)
        assert n <= 1024 and (n == 1024 or n & (n - 1) == 0)
    assert packing.pack(docs([])).count() == 0


def test_ids_are_those_of_the_other_library():
    """All documents of a table, and random Unicode with white space of every kind."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    some = " \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u200b\ufeff'.,-_0123456789abcABCéßжλ中文字🙂👍🏽é\x00\x7f"
    texts = ["".join(rng.choice(some) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += [f"{a}{'<|endoftext|>' * rng.randrange(1, 3)}{b}" for a, b in zip(texts[:100], texts[100:200])] + ["<|endoftext", "|endoftext|>", "< |endoftext|>"]
    folder = Path("/root/testdata/sf0.1/documents.parquet")
    if folder.exists():
        texts += [x for x in pq.read_table(folder, columns=["text"])["text"].to_pylist() if x]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, e in zip(part, t.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids, text[:80]


def test_chunks_of_many_texts_are_encoded_in_one_call():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    odd = [*ODD, None, "", "a", "\na", "a\n", "a\nb", "a\n\nb", "a \nb", "a\n b", "it's 'tis", "a\xa0b c", "a\x1cb\x1c\x1cc", "a <|endoftext|> b", "a\tb\n'll d", *(lone for s in " \t\x85\u3000" for lone in (s, f"a{s}", f"{s}a", f"a{s}{s}b"))]
    texts = odd + ["".join(rng.choice("ab  \n\n.'s1é文\t\x1c\xa0") for _ in range(rng.randrange(40))) for _ in range(3000)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    column = pa.array(["before", *texts, "after"], pa.string())[1:-1]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.many(column)] == want
    assert [np.frombuffer(own.encode(x or ""), "<u4").tolist() for x in texts] == want
    assert own.many(pa.array([], pa.string())) == [] and own.many(pa.array([None, ""], pa.string())) == [b"", b""]

    class Counted:
        calls = 0

        def encode_ordinary(self, text, encode=own.bpe.encode_ordinary):
            Counted.calls += 1
            return encode(text)

    plain = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) + ".\nNext" for _ in range(300)]
    want, own.bpe = own.many(pa.array(plain)), Counted()
    assert own.many(pa.array(plain)) == want and Counted.calls == 1  # a call for each chunk before


def test_redacted_rows_go_back_in_pieces():
    """About 1 MB of text each: whole batches, with all their new texts, stood in a worker's memory before."""
    texts = ["password=hunter2222 " + "x y " * 2500, None, ""] * 400
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts), "n": pa.array([None] * len(texts), pa.int64())})
    got = list(secret_links._redact(secret_links.REACH, "[SECRET]")(iter([batch.slice(1), batch.slice(0, 0)])))
    assert max(b.column(1).nbytes for b in got) < 3 << 20 and len(got) > 3
    rows = pa.Table.from_batches(got, batch.schema)
    assert rows["doc_id"].to_pylist() == list(range(1, len(texts)))
    assert rows["text"].to_pylist() == [x and "[SECRET] " + x.split(" ", 1)[1] for x in texts[1:]]


def test_packing_of_rows_without_ids_and_repeated(docs):
    rows = packing.pack(docs(["a b c", "a b c", None], [None, None, 4])).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 8 and all(r.doc_tokens == 4 for r in rows if r.doc_id is None)
    assert [r.length for r in rows if r.doc_id == 4] == [1]


def windows(p):
    """Fills of a packer's open windows by level."""
    return [[p.filled(w) for w in level] for level in p.at]


@pytest.mark.parametrize(("grain", "cut"), [(1, 1e9), (1, 3), (4, 1e9), (4, 5)])
def test_packing_chooses_the_least_sum_of_squares(grain, cut):
    rng, size = random.Random(4), 32
    p = packing.Packer(size, grain=grain, cut=cut)
    level = lambda fill: min(fill // grain, p.full)
    for i in range(600):
        a = rng.randrange(1, size)
        at = windows(p)
        n = [len(x) for x in at]

        def grown(*moves):
            """By how much the sum of squares grows when windows leave and come to levels."""
            after = list(n)
            for lv, by in moves:
                if lv < p.full:
                    after[lv] += by
            return sum(x * x for x in after) - sum(x * x for x in n)

        choices = {None: grown((level(a), 1))}
        for lv in range(p.full):
            if n[lv]:
                over = at[lv][-1] + a - size
                choices[lv] = grown((lv, -1), (level(at[lv][-1] + a), 1)) if over < grain else grown((lv, -1)) + cut + (grown((level(over), 1)) if lv != level(over) else 2 * n[level(over)] + 1)
        where, cost = p.best(a)
        assert cost == min(choices.values()) == choices[where]
        p.place([i, 0, b"\0" * 4 * a, a])
        assert [len(x) for x in windows(p)] == p.levels.tolist() and all(level(f) == lv for lv, fills in enumerate(windows(p)) for f in fills)
    assert p.closed["placed"] > 100


def test_open_windows_are_bounded_and_most_sequences_are_placed():
    p = packing.Packer(16, grain=2, cut=8)
    for i in range(2000):
        p.add(i, b"\0" * 4 * 9)
        assert p.levels.max() <= 9
    p.settle()
    assert sum(r[2] for r in p.rows) == 18_000
    rng = random.Random(8)
    p = packing.Packer()
    for i in range(1200):
        p.add(i, b"\0" * 4 * min(20_000, int(rng.lognormvariate(6.5, 1))))
    p.settle()
    assert p.closed["end"] < 0.1 * (p.closed["end"] + p.closed["placed"])


def test_leaks_are_found_and_clean_documents_left(spark, docs):
    rng = random.Random(6)
    items = [" ".join(rng.sample(WORDS, 30)) for _ in range(5)]
    edited = items[0].split()
    for i in (3, 14, 25):
        edited[i] = "changed"
    del edited[9]
    noise = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"{noise(50)} {items[1]} {noise(20)}", " ".join(edited).upper(), noise(500), f"{noise(30)} {' '.join(items[2].split()[:9])}", *ODD, f"{items[3]}\n{items[4]}!"]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (11, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs(texts), bench).collect()}
    last = len(texts) - 1
    assert set(got) == {(0, 1), (1, 0), (last, 3), (last, 4)}
    assert got[0, 1].score == 1 and (got[0, 1].first_word, got[0, 1].last_word) == (50, 79)
    kept = decontaminate.clean(docs(texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {0, 1, last}
    assert kept.columns == docs([]).columns
    assert decontaminate.find(docs(texts), bench.limit(0)).count() == 0 and decontaminate.find(docs([]), bench).count() == 0


@pytest.mark.parametrize("exact, copies", [(0, 17), (1, 40), (1, 3000)])
def test_edited_leaks_are_found_however_many(spark, docs, exact, copies):
    rng = random.Random(9)
    item = rng.sample(WORDS, 30)
    edited = list(item)
    edited[9] = edited[19] = "changed"
    half = item[:22]
    noise = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"{noise(8)} {' '.join(w)} {noise(8)}" for w in [*[item] * exact, *[edited] * copies, half]] + [f"{noise(8)} {' '.join(item[:5])} {noise(40)}" for _ in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.find(docs(texts), bench).collect()}
    assert set(got) == set(range(exact + copies + 1)) and min(got.values()) > 0.7


def alignments(texts, items, least=0.5):
    """(document, item) of score least or more, by aligning all pairs of whole texts."""
    import pyarrow as pa

    hashed = []
    for group in (texts, items):
        (c,) = textvec.chunks(pa.array(group), 1 << 30)
        w, h = decontaminate._words(c)
        hashed.append([h[a:b] for a, b in zip(w.first[:-1], w.first[1:])])
    return {(d, i) for d, t in enumerate(hashed[0]) for i, x in enumerate(hashed[1]) if decontaminate.align(x, t)[0] >= least * 2 * len(x)}


@pytest.mark.parametrize("every", [3, 4, 5, 6])
def test_copies_with_words_replaced_evenly_are_found(spark, docs, every):
    rng = random.Random(14)
    item = rng.sample(WORDS, 30)
    edited = ["changed" if i % every == every - 1 else w for i, w in enumerate(item)]
    left = [w for i, w in enumerate(item) if i % every != every - 1]
    added = [x for i, w in enumerate(item) for x in ([w, "added"] if i % every == every - 1 else [w])]
    noise = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"{noise(20)} {' '.join(w)} {noise(20)}" for w in (edited, left, added)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    want = alignments(texts, [" ".join(item)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs(texts), bench).collect()}
    assert got == want and len(want) == 3


def test_recall_against_alignment_of_all_pairs(spark, docs):
    """Random replacement, loss and insertion of 10 to 35 % of the words; README has the figure."""
    rng = random.Random(15)
    items = [" ".join(rng.sample(WORDS, 30)) for _ in range(6)]
    texts = []
    for n in range(600):
        w, rate = items[n % 6].split(), rng.uniform(0.1, 0.35)
        out = []
        for x in w:
            r = rng.random()
            if r > rate:
                out.append(x)
            elif r < rate * 0.7:
                out.append(rng.choice(WORDS))
            elif r < rate * 0.85:
                out += [x, rng.choice(WORDS)]
        noise = [rng.choice(WORDS) for _ in range(40)]
        texts.append(" ".join(noise[:20] + out + noise[20:]))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs(texts), bench).collect()}
    want = alignments(texts, items)
    print(f"recall {len(got & want) / len(want):.4f} of {len(want)}")
    assert got <= want and len(got & want) >= 0.98 * len(want) and len(want) > 300


def test_short_items_repeats_and_odd_rows(spark, docs):
    import time

    bench = spark.createDataFrame([(1, "four words right here"), (2, "four words right here"), (3, "one two"), (4, "a " * 500), (5, "seven words that stand in this order")], "item_id long, text string")
    clean = "four words are right here, and seven words that stand in some order"
    texts = ["so, Four words: right here!", "so, Four words: right here!", clean, "a " * 20_000, None, "one two"]
    began = time.perf_counter()
    got = decontaminate.find(docs(texts, [7, 7, 8, None, 9, 10]), bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(7, 1), (7, 2), (7, 1), (7, 2), (None, 4)], key=repr)
    assert time.perf_counter() - began < 60
    assert {r.score for r in got} == {1.0}


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", None, "", "same", "same", "x" * 300_000, "same", "a\r\n\r\nb"]
    rows = [(i, None if i == 2 else f"http://h/{i}\n", t) for i, t in enumerate(html)] + [(None, "u", "same"), (6, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages, folder)
    got = warc.read(index, folder, gap=10, most=100).collect()
    assert len(got) == len(rows)
    for r in got:
        text = html[r.page_id] if r.page_id is not None else "same"
        payload = (text or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.digest(payload)
        first = {"same": 6}.get(text, 2 if not text else r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.html == (payload.decode() if r.record_type == "response" else None)
    some = warc.read(index.where("page_id = 5"), folder).collect()
    assert [len(r.html) for r in some] == [300_000]
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("least", [5])
def test_small_payloads_are_all_responses(spark, least):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer"), (4, "u", "longer")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.round_trip(pages, least).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
