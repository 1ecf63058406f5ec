"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import byte_bpe, decontaminate, hard_negatives, language_codes, line_rules, ngram_jaccard, packing, quality_pu, secret_links, sharding, spelling, toxicity, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply(table(spark, sf_dir, "documents"))


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_codes.identify(docs, language_codes.fit(docs))


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_pu.score(docs, quality_pu.fit(docs, labels))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, relabel=lambda i, x: F.when(i % 7 == 0, (x + 1) % 10).otherwise(x))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_extendible_sharding, op4_line_frequency, op5_secret_links, op6_packing, op7_toxicity_grammar, op8_language_codes, op9_quality_pu, op10_ngram_jaccard, op11_spelling_variants, op12_byte_bpe, op13_hard_negatives)}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h FROM documents),
x AS (SELECT d.*, k.depth, h >> (48 - k.depth) AS prefix FROM d, (SELECT CAST(unnest(range(0, 49)) AS BIGINT) AS depth) k),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM x GROUP BY 1, 2),
f AS (SELECT x.doc_id, x.n_bytes, x.depth, x.prefix, s.shard_bytes, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.depth) AS r
      FROM x JOIN s USING (depth, prefix) WHERE s.shard_bytes <= 1048576)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(prefix), 48, '0'), CAST(49 - depth AS BIGINT), depth) END AS shard, depth, shard_bytes,
       CAST(0 AS BIGINT) AS page, false AS oversized FROM f WHERE r = 1
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, '')) AS doc, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rn, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rn, count(DISTINCT i + k.j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY rn, g) AS c FROM g), (SELECT unnest(range(0, 3)) AS j) k WHERE c > 1 GROUP BY 1),
li AS (SELECT rn, doc, host, regexp_replace(lower(trim(x, E' \t\n\x0b\f\r')), '[0-9]+', '0', 'g') AS nl, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS w
       FROM (SELECT rn, doc, host, unnest(l) AS x FROM d)),
f AS (SELECT host, nl FROM li GROUP BY 1, 2 HAVING count(DISTINCT doc) > 10),
r AS (SELECT rn, sum(w) AS removed FROM li JOIN f USING (host, nl) GROUP BY 1),
b AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN rep USING (rn) LEFT JOIN r USING (rn))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (10 * (n_words - removed_words) < 2 * n_words) AS kept, removed_words FROM b
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""

OP13_SQL = """
WITH t AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, b.r AS b, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM t a, t b WHERE a.id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_extendible_sharding": OP3_SQL, "op4_line_frequency": OP4_SQL.replace("\\\\", "\\"), "op10_ngram_jaccard": OP10_SQL, "op13_hard_negatives": OP13_SQL}
