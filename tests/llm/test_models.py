"""Classifiers by held-out accuracy, and the pipeline by brute force."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import language_codes, models, ngram_jaccard, quality_pu, registry, toxicity
from gridloom.llm import textvec as tv
from gridloom.session import table

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def auc(y, s):
    order = np.argsort(s, kind="stable")
    _, inverse, count = np.unique(s[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    up = y[order] == 1
    return (rank[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


@needs_tables
@pytest.mark.parametrize("query, label, least", [("op7_toxicity_grammar", "toxic", 0.93), ("op9_quality_pu", "quality", 0.9)])
def test_scores_on_the_held_out_fold(spark, query, label, least):
    # sf0.01 has labels of some thirty toxic documents in four languages: too few to learn words from
    sf = "/root/testdata/sf0.1"
    got = registry.queries()[query](spark, sf).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    labels = table(spark, sf, "labels").toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m["held_out"]]
    assert auc(m[label].to_numpy(), m["score"].to_numpy()) >= least


@needs_tables
def test_languages_of_the_held_out_fold(spark):
    got = registry.queries()["op8_language_codes"](spark, SF).toPandas().merge(table(spark, SF, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    m = got[got["held_out"]]
    assert (m["lang"] == m["lang_pred"]).mean() >= 0.97


def test_language_of_odd_texts(spark, docs):
    train = docs([f"the and of with {i}" for i in range(40)], lang="en").union(docs([f"der und die das {i}" for i in range(100, 140)], list(range(100, 140)), lang="de"))
    model = language_codes.fit(train)
    got = language_codes.identify(docs([None, "", "123 !!", "the and", "und die"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de"] and [r.score for r in got[:3]] == [0, 0, 0]
    nothing = language_codes.fit(docs([]))
    assert [r.lang_pred for r in language_codes.identify(docs(["the"]), nothing).collect()] == ["und"]
    assert language_codes.identify(docs([]), model).count() == 0


def test_codewords_differ_in_many_bits():
    for k in (2, 3, 4, 5, 9, 40):
        c = language_codes.code(k)
        gap = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
        assert gap >= (c.shape[1] // 4 if k > 2 else 1)


def grammar(**more):
    return toxicity.Grammar({"idiot": 4.0, "kill": 2.5, "fool": 3.0}, {"blep": 3.0}, np.zeros(toxicity.FEATURES + 1), **more)


def one_after_the_other(g, text):
    """(weights, reported) of each clause with an insult or a threat, every transducer run by itself."""
    out = []
    for clause in toxicity._END.split(text.translate(toxicity._FOLD)):
        tokens = [g.symbol(x) for x in toxicity._SPLIT.split(clause) if x]
        if any(x[1] or x[2] for x in tokens):
            total, ends = np.zeros(4), []
            for part in g.parts:
                tokens, w, end = part.read(tokens)
                total += w
                ends.append(part.states[end])
            out.append((tuple(np.round(total, 9)), ends[1]))
    return out


def test_the_composed_machine_is_its_parts_one_after_the_other():
    rng = np.random.default_rng(3)
    g = grammar()
    words = ["idiot", "Idiot,", "kill", "HURT", "you", "they.", "not", "said", "ok", "ok", "ok", "fool!", "bleping", "blep", "TÖTEN", "\n", "3.5", "\u201cidiot\u201d", "end.", ";", "é", "nie", "sagte"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(300)] + ["", " ", None, "idiot", "x" * 9 + " not " + "ok " * 9000 + "idiot " * 300 + "you"]
    got = [[] for _ in texts]
    for size in (1 << 20, 64):
        for own in got:
            own.clear()
        for c in tv.chunks(pa.array(texts, pa.string()), size):
            doc, total, reported, _ = toxicity.clauses(g, c)
            for d, w, r in zip(doc.tolist(), total, reported.tolist()):
                got[c.lo + d].append((tuple(np.round(w, 9)), r))
        for text, own in zip(texts, got):
            assert own == one_after_the_other(g, text or ""), text


def test_grammar_composes():
    g = grammar()
    f = lambda text: toxicity.features(g, pa.array([text]))[0]
    plain, targeted, negated, reported, after = map(f, ("an idiot here.", "you idiot.", "not an idiot.", "he said idiot.", "idiot, said he."))
    assert targeted[0] > plain[0] > negated[0] > 0 and reported[0] < targeted[0] and after[0] == reported[0]
    assert negated[6] > 0 and reported[7] > 0 and targeted[5] > 0 and not plain[4:].any()
    assert g.symbol("bleping")[1] and not g.symbol("ble")[1] and (f("clean. idiot. clean")[:3] == plain[:3]).all()


def test_threats_match_by_themselves_and_clauses_are_read_whole():
    g = toxicity.Grammar({"idiot": 4.0}, {}, np.zeros(toxicity.FEATURES + 1))
    f = lambda *texts: toxicity.features(g, pa.array(texts))
    threat, after, lone, apart, insult = f("well I will kill you today.", "you I will kill", "they say", "to kill time. you know", "an idiot here.")
    assert threat[0] == after[0] > 0 and threat[4] > 0 and not lone.any() and not apart.any() and insult[0] == 4
    assert f("you will not kill them")[0, 0] < threat[0]
    # however long a clause is, what stands at its ends counts
    long = f("you " + "ab " * 5000 + "idiot " + "ab " * 5000 + "idiot", "idiot " + "ab " * 5000 + "he said")
    assert long[0, 1] == np.log1p(1) and long[0, 0] == 8 + toxicity.PULL and long[1, 0] == (4 + toxicity.PULL) * toxicity.REPORTED
    assert f("idiot idiot ab")[0, 0] == 8 and f("idiot\nidiot\nab")[0, 1] == np.log1p(2)


def test_the_lexicon_is_read_as_the_forms_are_learned():
    g = grammar()
    texts = ["Idiot! (kill) you\tsaid it's", "TÖTEN é|fool|", "¿idiot? «fool» …kill—you"]
    for c in tv.chunks(pa.array(texts)):
        w, _ = toxicity._split(c)
        got = [[g.symbols[i] for i in toxicity._symbols(g, w)[a:b]] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [[g.symbol(x) for x in toxicity._SPLIT.split(t.translate(toxicity._FOLD)) if x] for t in texts]


@pytest.mark.parametrize("ids", [[None] * 400, [1] * 400])
def test_rows_without_ids_or_of_one_id_are_sampled_like_others(spark, docs, ids):
    d = docs([f"text {i} of some words" for i in range(400)], ids).repartition(4)
    got = models.sample(d, 100).count()
    assert 50 <= got <= 150 and models.sample(d, 400).count() == 400
    train = docs([("the and of " if i % 2 else "der und die ") + str(i) for i in range(400)], ids).withColumn("lang", F.when(F.col("text").startswith("the"), "en").otherwise("de"))
    model = language_codes.fit(train, most=50)
    assert [r.lang_pred for r in language_codes.identify(docs(["the and", "die und"], [None, 3]), model).collect()] == ["en", "de"]
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    many = quality_pu.fit(d, labels, most=60)
    assert many is None or 0 < many.prior < 1
    assert toxicity.fit(d, labels, most=60) is None  # nothing but toxic rows, or none


def test_languages_are_those_of_a_dense_decoder(docs):
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "x" * 4000, "la la land", None, "", "12", "the le der", "É"]
    langs = ["en", "de", "fr"]
    train = docs([f"{t} {i}" for i in range(12) for t in texts[:3]]).withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), (F.col("doc_id") % 3 + 1).cast("int")))
    model = language_codes.fit(train)
    assert model.langs == sorted(langs)
    got = language_codes.identify(docs(texts + texts), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts + texts):
        b = [language_codes._FOLD[x] for x in (text or "").encode()]
        cells = []
        for i in range(len(b) - 2):
            x, y, z = (int(v) for v in b[i : i + 3])
            if y != 32 and (x != 32 or z != 32):
                h = sum(int(language_codes._SPREAD[j][v]) for j, v in enumerate((x, y, z))) & 0xFFFFFFFF
                cells.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> 17)
        mean = model.table[cells].astype(float).mean(0) if cells else np.zeros(model.code.shape[1])
        margin = (mean - model.mid) / model.scale
        cost = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margin, word)) / model.trust.sum() for word in model.code]
        if not any(ch.isalpha() for ch in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            p = np.exp(-4 * np.array(cost))
            assert r.lang_pred == model.langs[int(np.argmin(cost))] and abs(r.score - p.max() / p.sum()) < 1e-6
            assert r.ambiguous == (sorted(cost)[1] - sorted(cost)[0] < model.near)


def test_risk_descends_by_its_gradient():
    rng = np.random.default_rng(2)
    zp, zu = np.column_stack([rng.normal(0.5, 1, (40, 3)), np.ones(40)]), np.column_stack([rng.normal(0, 1, (60, 3)), np.ones(60)])
    for prior, scale in ((0.3, 0.5), (0.7, 1.0), (0.95, 3.0)):
        for _ in range(10):
            w = rng.normal(0, scale, 4)
            value, direction = quality_pu.risk(w, zp, zu, prior)
            sig = lambda z: 1 / (1 + np.exp(-z))
            loss = lambda z: -np.log(sig(z))
            negative = lambda v: loss(-(zu @ v)).mean() - prior * loss(-(zp @ v)).mean()  # noqa: E731, B023
            whole = lambda v: prior * loss(zp @ v).mean() + negative(v)  # noqa: E731, B023
            assert abs(value - (prior * loss(zp @ w).mean() + max(0, negative(w)))) < 1e-9
            f = whole if negative(w) >= 0 else lambda v: -negative(v)  # noqa: B023
            numeric = [(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
            assert np.allclose(numeric, direction, atol=1e-6)


def test_a_corpus_of_few_good_documents(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (300, 3))
    u = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(5, 0.5, (240, 3))])
    m = quality_pu.fit_arrays(p, u)
    assert 0.1 <= m.prior <= 0.35
    assert (m.score(rng.normal(5, 0.5, (200, 3))) > 0.5).mean() < 0.05


def test_scores_of_long_repeated_and_odd_rows(spark, docs):
    """Long texts, repeated rows, null ids and texts, other columns (`node`): one row for each row."""
    rng = np.random.default_rng(5)
    texts = ["you idiot " + " ".join(rng.choice(["a", "b", "cat"], 20)) if i % 3 == 0 else " ".join(rng.choice(["fine", "day", "sun"], 25)) for i in range(60)]
    train = docs(texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    odd = docs([*texts[:2], texts[0], None, "", "word " * 200_000, texts[0]], [0, 1, 0, 5, None, 6, None])
    for op in (toxicity, quality_pu):
        model = op.fit(train, labels)
        got = op.score(odd, model).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        same = [r.score for r in got if r.doc_id == 0] + [got[6].score]
        assert len(set(same)) == 1
        assert op.score(docs([]), model).count() == 0
    model = language_codes.fit(train)
    got = language_codes.identify(odd, model).collect()
    assert len(got) == 7 and [r.lang_pred for r in got] == ["en", "en", "en", "und", "und", "en", "en"]


def test_classifiers_without_anything_to_learn(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs([None, "", "a b"])
    assert toxicity.fit(d, labels) is None and quality_pu.fit(d, labels) is None
    assert [r.predicted for r in toxicity.score(d, None).collect()] == [0, 0, 0]
    assert [r.predicted for r in quality_pu.score(d, None).collect()] == [1, 1, 1]
    odd = spark.createDataFrame([(None, 1, 1), (0, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(d, odd) is None and quality_pu.fit(d, odd) is None


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (300, 3))
    u = np.vstack([rng.normal(0, 1, (240, 3)), rng.normal(5, 0.5, (60, 3))])
    m = quality_pu.fit_arrays(p, u)
    assert 0.6 <= m.prior <= 0.95
    assert (m.score(rng.normal(0, 1, (200, 3))) > 0.5).mean() > 0.9 and (m.score(rng.normal(5, 0.5, (200, 3))) > 0.5).mean() < 0.1


@needs_tables
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = quality_pu.fit(docs, table(spark, sf, "labels"))
    good = {r.doc_id for r in quality_pu.score(docs, model).collect() if r.score >= 0.7}
    one = corpus_pipeline.quality(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns
    two = corpus_pipeline.near_duplicates(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == {r.component_id for r in ngram_jaccard.link(one).collect()}
    three = corpus_pipeline.decontamination(spark, two, sf)
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    kept = {r.doc_id: r.text for r in three.collect()}
    assert not any(i in t for t in kept.values() for i in items) and len(kept) > 0.6 * two.count()
    four = corpus_pipeline.secrets(spark, three, sf)
    rows = four.collect()
    assert four.columns == docs.columns and {r.doc_id for r in rows} == set(kept) and all(len(r.text) == r.n_chars for r in rows)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == set(kept)


def test_repeated_rows_leave_one(spark, docs):
    base = " ".join(f"w{i}" for i in range(40))
    d = docs([base, base, base + " x", "", None], [4, 4, 9, 5, None])
    left = corpus_pipeline.near_duplicates(spark, d, "").collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == [(4, base), (5, "")] and len(left) == 3


def test_near_copies_are_told_by_row(spark, docs):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    left = lambda texts, ids: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs(texts, ids), "").collect()), key=repr)
    a, b, c = map(text, "abc")
    # one row without a doc_id links: other rows without one are no concern
    assert left([a, a, b, None, ""], [1, None, None, None, None]) == sorted([(1, a), (None, b), (None, None), (None, "")], key=repr)
    # two texts under one doc_id, one of them a copy of another's
    assert left([a, a + " x", b, b + " x"], [3, 7, 7, 9]) == [(3, a), (7, b)]
    # copies without ids or under one id leave one
    got = left([a, a + " x", a, b, b + " x", c], [None, None, None, 5, 5, 5])
    assert len(got) == 3 and {k for k, _ in got} == {None, 5} and (5, c) in got


def test_pipeline_of_odd_tables(spark, docs, tmp_path):
    """Empty tables, null and repeated ids, null and empty texts, ties; and a whole run against its parts."""
    from gridloom.llm import packing

    good = " ".join(f"word{i} and then" for i in range(40)) + "."
    some = [good, good, good + " more", None, "", "password=hunter2222 " + good[:300], good.upper()]
    ids = [3, 3, None, None, 7, 8, 9]
    bench = spark.createDataFrame([(1, "an item of the benchmark that is in no document at all")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    for k, (d, b, y) in enumerate([(docs([]), bench, labels), (docs(some, ids), bench.limit(0), labels.limit(0)), (docs(some, ids), bench, labels)]):
        sf = f"{tmp_path}/{k}"
        for name, table_ in (("documents", d), ("benchmark", b), ("labels", y)):
            table_.write.parquet(f"{sf}/{name}.parquet")
        rows = corpus_pipeline.run(spark, sf).collect()
        kept = d
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
        kept = kept.collect()
        if not k:
            assert rows == [] and kept == []
            continue
        # one of the copies stays, and rows without words; the secret is out of its text
        texts = sorted((r.text or "") for r in kept)
        assert sum(t.startswith("word0") or t.startswith("WORD0") for t in texts) == 1 and not any("hunter" in t for t in texts)
        own = packing.Ids(*map(__import__("public_tokenizers").path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")))
        assert sorted(len(own.encode(t)) // 4 + 1 for t in texts) == sorted(r.doc_tokens for r in rows if r.start == 0)
