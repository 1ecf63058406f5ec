"""Columns named as the operators' own, and the one-pass scan for endpoints."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import line_rules, secret_links

NAMES = ["line_rules_row", "line_rules_gone", "near_duplicates_row", "Near_Duplicates_Row_", "component_id", "group", "n", "first", "order", "row", "_metadata"]
#: What an endpoint is, as one pattern; it takes squared time on runs of host characters.
ENDPOINT = re.compile(r"\b(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.@:/?&=%~+-]+|(?:[A-Za-z0-9-]+\.)+[a-z]{2,10}:[0-9]{2,5}|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?)", re.ASCII)


def test_columns_named_as_the_operators_own_stay(docs):
    base = " ".join(f"w{i}" for i in range(60))
    plain = docs([base, base, base + " x", "", None], [4, 4, 9, 5, None])
    d = plain.withColumns({c: F.lit(7) for c in NAMES})
    for f in (line_rules.clean, lambda x: corpus_pipeline.near_duplicates(None, x, "")):
        got = f(d)
        assert got.columns == d.columns
        rows = got.collect()
        assert rows and all(r[c] == 7 for r in rows for c in NAMES)
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in f(plain).collect())


def test_endpoints_equal_the_pattern():
    rng = random.Random(3)
    parts = ["a", "ab", "abc", ".", "..", "-", ":", "://", "1", "12", "1.2.3.4", "_", " ", "é", "host.com:80", "x.yz:8080", "A", "abcdefghijkl", ":123", "/", "\n", "9.9.9.9:22"]
    for _ in range(100_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert secret_links.endpoints(text) == [m.span() for m in ENDPOINT.finditer(text)], text


@pytest.mark.parametrize("unit", ["a.", "a-", "1.", "a.bc:1", "a.bc:12", "x.yz:8080.", "password ", "user ", "0a", "/aB3"])
def test_long_texts_of_any_kind_take_seconds(unit):
    began = time.perf_counter()
    secret_links.spans(unit * (10_000_000 // len(unit)))
    assert time.perf_counter() - began < 60
