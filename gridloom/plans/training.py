"""Queries of the token pipeline, on documents, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bytepairs, loader
from ..operators import tokens as tk
from ..session import scratch, stored, table
from ..sources import token_shards
from .catalog import query

TOK = "SELECT doc_id, CAST(j AS BIGINT) AS j, (doc_id * 31 + j * 7 + length(w)) % 50257 AS tok FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS j FROM documents)"
SIZES = "SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents"
STREAM = f"SELECT tok, row_number() OVER (ORDER BY doc_id, j) - 1 AS p FROM ({TOK})"


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))


def _tokens(spark, sf_dir, shard_size: int = 20_000):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", " ")).cast("long").alias("n"))
    t = tk.stream(d, "doc_id", "n").select("doc_id", "base", F.posexplode(F.split("text", " ")).alias("j", "w"))
    p = F.col("base") + F.col("j")
    return t.select(F.floor(p / shard_size).alias("shard"), (p % shard_size).alias("pos"), ((F.col("doc_id") * 31 + F.col("j") * 7 + F.length("w")) % 50257).alias("tok"))


def _pieces(spark, sf_dir, shard_size: int = 20_000):
    """The same tokens as pieces of shards."""
    ids = F.transform(F.split("text", " "), lambda w, j: ((F.col("doc_id") * 31 + j * 7 + F.length(w)) % 50257).cast("int"))
    return tk.shard_pieces(table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids", shard_size)


SHARD = f"SELECT p // 20000 AS shard, p % 20000 AS pos, tok FROM ({STREAM})"


@query("S19 U02", f"SELECT shard, count(*) AS n, CAST(sum(tok) AS BIGINT) AS sum FROM ({SHARD}) GROUP BY shard")
def token_stream(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("sum"))


@query("K07 W13", f"WITH b AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS base FROM ({SIZES})), p AS (SELECT *, unnest(range(CAST(base // 20000 AS BIGINT), CAST((base + n - 1) // 20000 + 1 AS BIGINT))) AS shard FROM b) SELECT doc_id, CAST(shard AS BIGINT) AS shard, CAST(greatest(base, shard * 20000) - base AS BIGINT) AS start, CAST(least(base + n, (shard + 1) * 20000) - greatest(base, shard * 20000) AS BIGINT) AS length FROM p")
def shard_packing(spark, sf_dir):
    return tk.shards_of(_sizes(spark, sf_dir), "doc_id", "n", 20_000)


@query("W07", f"SELECT shard, pos, tok, lead(tok) OVER (PARTITION BY shard ORDER BY pos) AS target FROM ({SHARD})")
def token_lead_targets(spark, sf_dir):
    return tk.next_token(_tokens(spark, sf_dir))


@query("P04 X03", f"WITH t AS (SELECT *, lead(tok) OVER (PARTITION BY shard ORDER BY pos) AS target, count(*) OVER (PARTITION BY shard) AS n FROM ({SHARD})) SELECT shard, (pos - 512) // 1024 AS step, ((pos - 512) % 1024) // 128 AS row, (pos - 512) % 128 AS t, tok AS input, target FROM t WHERE pos >= 512 AND (pos - 512) % 1024 < 512 AND pos // 1024 < (n - 1) // 1024")
def batch_slices(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return tk.batches(t, t.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), 4, 128, ranks=2, rank=1)


@query("K08 T06", f"SELECT split, count(*) AS n, CAST(sum(tok) AS BIGINT) AS sum FROM (SELECT tok, CASE WHEN p < 32768 THEN 'val' ELSE 'train' END AS split FROM ({STREAM})) GROUP BY split")
def val_head_split(spark, sf_dir):
    t = _tokens(spark, sf_dir, 1 << 60)
    return tk.head_split(t, 32768).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("sum"))


@query("P11", f"SELECT shard, pos, tok FROM ({SHARD}) WHERE tok < 0 OR tok >= 50000")
def token_range_check(spark, sf_dir):
    return tk.out_of_range(_tokens(spark, sf_dir), 50_000)


@query("S12 S13 K05 A27", f"SELECT CAST(shard AS INTEGER) AS shard, count(*) AS n, CAST(sum(tok) AS BIGINT) AS sum, CAST(sum(tok * (pos % 97)) AS BIGINT) AS place FROM ({SHARD}) GROUP BY shard")
def token_shard_roundtrip(spark, sf_dir):
    path = scratch(spark, "shards")
    token_shards.write_pieces(_pieces(spark, sf_dir), path)
    back = token_shards.read(spark, path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("sum"), F.sum(F.col("tok") * (F.col("pos") % 97)).alias("place"))


@query("P02 S18", "SELECT doc_id, CAST(i AS BIGINT) AS i, length(CASE WHEN i < n - 1 THEN s || chr(10) ELSE s END) AS len FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents)")
def sections(spark, sf_dir):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tk.sections(doubled)).alias("i", "s"))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), F.length(F.replace(F.col("s"), F.lit("\n\n"), F.lit("\n"))).cast("long").alias("len"))


@query("J04", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS t FROM conversations) SELECT CAST(length(w) AS BIGINT) AS tok, count(*) AS n, round(sum(length(w) * 0.25::DOUBLE + t * 0.125::DOUBLE), 4) AS grad FROM w GROUP BY 1")
def embedding_gradient(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.posexplode(F.split("text", " ")).alias("t", "w")).select("t", F.length("w").cast("long").alias("tok"))
    wte = w.select("tok").distinct().withColumn("e", F.col("tok") * 0.25)
    x = w.join(wte, "tok").withColumn("x", F.col("e") + F.col("t") * 0.125)
    return x.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("grad"))


LOSS = "SELECT doc_id AS idx, CAST(quality AS BIGINT) AS label, CAST(c AS BIGINT) AS choice, ((doc_id * 13 + c * 29 + t * 5) % 37) / 8.0::DOUBLE AS loss, (doc_id + c + t) % 3 > 0 AS mask FROM labels, (SELECT unnest(range(0, 4)) AS c), (SELECT unnest(range(0, 6)) AS t)"


@query("A17", f"WITH c AS (SELECT idx, label, choice, avg(loss) FILTER (mask) AS m, sum(loss) FILTER (mask) AS s FROM ({LOSS}) GROUP BY 1, 2, 3), r AS (SELECT idx, label, row_number() OVER (PARTITION BY idx ORDER BY m, choice) AS a, row_number() OVER (PARTITION BY idx ORDER BY s, choice) AS b, choice FROM c) SELECT idx, label, max(CASE WHEN a = 1 THEN choice END) AS pick_norm, max(CASE WHEN b = 1 THEN choice END) AS pick_sum FROM r GROUP BY 1, 2")
def mc_eval_accuracy(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").cast("long").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice"))
    x = x.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5))))
    loss = ((F.col("idx") * 13 + F.col("choice") * 29 + F.col("t") * 5) % 37) / F.lit(8.0)
    x = x.select("idx", "label", F.col("choice").cast("long").alias("choice"), loss.alias("loss"), ((F.col("idx") + F.col("choice") + F.col("t")) % 3 > 0).alias("mask"))
    return tk.example_losses(x)


@query("P10", "SELECT item_id, 'Question: ' || text || chr(10) || chr(10) || 'Answer:' AS prompt FROM benchmark")
def rendered_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Question: "), "text", F.lit("\n\nAnswer:")).alias("prompt"))


@query("", "SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations")
def printable_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("text"))


@query("P03")
def shuffled_rows(spark, sf_dir):
    rows = _sizes(spark, sf_dir).withColumn("shard", F.col("doc_id") % 4)
    return tk.shuffled(rows, "doc_id", 1337)


@query("P09", "SELECT doc_id, n, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 16.0)) AS BIGINT) AS rank FROM (SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents)")
def work_split(spark, sf_dir):
    """Documents in order to sixteen ranks, ceil(n / 16) each."""
    return loader.split(_sizes(spark, sf_dir), "doc_id", 16)


TURNS = "SELECT conv_id * 100 + turn AS id, text FROM conversations"


@query("P01 UX5", f"""WITH w AS (SELECT id, unnest(string_split(text, ' ')) AS w FROM ({TURNS})), v AS (SELECT w, row_number() OVER (ORDER BY encode(w)) - 1 AS tok FROM (SELECT DISTINCT w FROM w WHERE w <> '')), s AS (SELECT count(*) AS n FROM v)
SELECT 'words' AS model, id, count(v.tok) + 1 AS n, CAST(coalesce(sum(v.tok), 0) + any_value(s.n) AS BIGINT) AS sum, CAST(any_value(s.n) AS BIGINT) AS first FROM w LEFT JOIN v USING (w), s GROUP BY id
UNION ALL SELECT 'bytes', id, strlen(text) + 1, CAST(256 + list_sum(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)) AS BIGINT), 256 FROM ({TURNS}) WHERE text <> ''
UNION ALL SELECT 'bytes', id, 1, 256, 256 FROM ({TURNS}) WHERE text = ''""")
def tokenised_turns(spark, sf_dir):
    """Each turn's tokens by two models' tokenizers, the end of a text before them."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    out = None
    for model in ("words", "bytes"):
        t = tk.tokenised(c, "id", "text", model)
        t = t.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("sum"), F.max(F.when(F.col("pos") == 0, F.col("tok"))).alias("first")).select(F.lit(model).alias("model"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("P01 P13 P12")
def tokenised_documents(spark, sf_dir):
    """Each document's byte-pair ids with the end of a text before them: how many, their sum, and the bytes they stand for."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = stored(bytepairs.tokenised(d, "doc_id", "text", "gpt-2", _ranks()), "ids")
    back = bytepairs.detokenised(ids, "doc_id", "ids", "gpt-2", _ranks())
    n = ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum"))
    return n.join(back.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.crc32("bytes").alias("crc32")), "doc_id")


@query("P01 K05 K07 S12")
def tokenised_shards(spark, sf_dir):
    """Byte-pair ids of all documents end to end, cut into shards of 100,000 tokens, written and read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bytepairs.tokenised(d, "doc_id", "text", "gpt-2", _ranks())
    path = scratch(spark, "shards")
    token_shards.write_pieces(tk.shard_pieces(ids, "doc_id", "ids", 100_000), path, bytepairs.WIDTH["gpt-2"])
    return token_shards.read(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("sum"), F.sum(F.col("tok") * (F.col("pos") % 97)).alias("place"))
