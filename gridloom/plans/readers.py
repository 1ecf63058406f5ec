"""Queries that write a table in one of the text or binary formats and read it back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import telemetry
from ..operators.ordering import accumulated
from ..sources import binary_files, text_files
from ..session import scratch, stored, table
from .catalog import query


@query("S15", "SELECT item_id, CAST(item_id % 4 AS INTEGER) AS label, CAST(4 AS INTEGER) AS endings, CAST(length(text) AS INTEGER) AS ctx, 'e' || (item_id % 4) || ' \"q\" ' || item_id AS chosen FROM benchmark")
def jsonl_examples(spark, sf_dir):
    path = scratch(spark, "examples")
    i = F.col("item_id")
    endings = F.array(*[F.concat(F.lit(f'e{k} "q" '), i.cast("string")) for k in range(4)])
    table(spark, sf_dir, "benchmark").select(i.alias("ind"), F.col("text").alias("ctx"), (i % 4).cast("int").alias("label"), endings.alias("endings")).write.json(path)
    e = text_files.examples(spark, path)
    return e.select(F.col("ind").alias("item_id"), "label", F.size("endings").alias("endings"), F.length("ctx").alias("ctx"), F.get("endings", F.col("label")).alias("chosen"))


@query("S16", "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n FROM conversations")
def json_array_shards(spark, sf_dir):
    path = scratch(spark, "stories")
    c = table(spark, sf_dir, "conversations").withColumn("shard", F.floor(F.col("conv_id") / 20))
    # a shard has twenty conversations at most
    whole = c.groupBy("shard").agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("value"))
    whole.select("value").repartition(8, "value").write.option("maxRecordsPerFile", 1).text(path)
    back = text_files.stories(spark, path, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("S17", "SELECT p_partkey, p_name AS question, CAST(p_partkey % 4 AS INTEGER) AS label, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN 'say \"c\", twice' ELSE CAST(p_size AS VARCHAR) END AS answer FROM part")
def letter_csv(spark, sf_dir):
    path = scratch(spark, "questions")
    p = table(spark, sf_dir, "part")
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p_partkey") % 4 + 1).cast("int"))
    p.select(F.concat_ws("|", "p_partkey", "p_name").alias("question"), "p_brand", "p_type", F.lit('say "c", twice').alias("c"), F.col("p_size").cast("string").alias("d"), letter.alias("letter")).write.option("escape", '"').csv(path)
    q = text_files.letter_questions(spark, path)
    two = F.split("question", r"\|", 2)
    return q.select(two[0].cast("long").alias("p_partkey"), two[1].alias("question"), "label", F.get("endings", F.col("label")).alias("answer"))


@query("S18 P02", "WITH n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT CAST(i AS INTEGER) AS i, r_name || ':' || n_name AS name, i < c - 1 AS blank FROM n")
def whole_text_sections(spark, sf_dir):
    path = scratch(spark, "whole")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    blocks = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat("r_name", F.lit(":"), "n_name").alias("t")))).alias("b"))
    blocks.select(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("value")).repartition(5, "value").write.option("maxRecordsPerFile", 1).text(path)
    s = text_files.whole_sections(spark, path)
    return s.select("i", F.trim(F.regexp_replace("section", "\n", "")).alias("name"), F.endswith("section", F.lit("\n\n")).alias("blank"))


KERNELS = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'void encoder<float>' WHEN 1 THEN 'adamw_kernel' WHEN 2 THEN 'int ampere_bf16_x' WHEN 3 THEN 'fused_classifier' ELSE 'layernorm<4>' END AS kernel, coalesce(round(value, 3), 0) AS ms FROM events"


def _kernels(spark, sf_dir):
    k = F.element_at(F.array(*map(F.lit, ("void encoder<float>(int)", "adamw_kernel(a b)", "int ampere_bf16_x(int)", "fused_classifier(p)", "layernorm<4>()"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), k.alias("name"), F.coalesce(F.round("value", 3), F.lit(0.0)).alias("ms"))


@query("S23 A21 A22", f"""WITH k AS ({KERNELS}), p AS (SELECT *, CASE WHEN kernel LIKE '%encoder%' THEN 'enc' WHEN kernel LIKE '%classifier%' THEN 'cls' WHEN kernel LIKE '%adamw%' THEN 'opt' ELSE 'layer' END AS pass,
  CASE WHEN kernel LIKE '%ampere_bf16%' THEN 'ampere_bf16' ELSE regexp_replace(regexp_replace(kernel, '^[a-z]+ ', ''), '<.*', '') END AS fn FROM k),
  t AS (SELECT pass, fn, count(*) AS calls, sum(ms * CASE WHEN pass = 'layer' THEN 12 ELSE 1 END) AS total, avg(ms) AS mean, sum(ms * id) / nullif(sum(ms), 0) AS weighted FROM p GROUP BY 1, 2)
SELECT pass, fn, calls, round(total, 4) AS total, round(mean, 6) AS mean, round(weighted, 4) AS weighted, round(total / (SELECT sum(total) FROM t), 8) AS share FROM t""")
def profiler_csv(spark, sf_dir):
    """Per pass and kernel: calls, time (layers count twelve times), mean, a utilisation weighted by time, share."""
    path = scratch(spark, "profile")
    rows = _kernels(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("name").alias("Kernel Name"), F.col("ms").cast("string").alias("ms"))
    units = spark.createDataFrame([("", "", "ms")], rows.schema)
    units.unionByName(rows).coalesce(4).write.csv(path, header=True)
    p = text_files.profile(spark, path, "Kernel Name", ["ms"])
    k = telemetry.kernel_pass(F.col("kernel"))
    p = p.select("id", k.alias("pass"), telemetry.kernel_function(F.col("kernel")).alias("fn"), "ms")
    times = F.when(F.col("pass") == "layer", 12).otherwise(1)
    t = p.groupBy("pass", "fn").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("ms") * times).alias("total"), F.avg("ms").alias("mean"), F.try_divide(F.sum(F.col("ms") * F.col("id")), F.nullif(F.sum("ms"), F.lit(0.0))).alias("weighted"))
    t = stored(t, "profile-totals")
    whole = t.agg(F.sum("total").alias("whole"))
    return t.crossJoin(F.broadcast(whole)).select("pass", "fn", "calls", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("weighted", 4).alias("weighted"), F.round(F.col("total") / F.col("whole"), 8).alias("share"))  # one row


@query("S28", "SELECT event_id AS line, round(abs(value) % 10, 6) AS value FROM events WHERE event_id >= 500 AND event_id < 510")
def loss_columns(spark, sf_dir):
    path = scratch(spark, "losses")
    e = table(spark, sf_dir, "events").select("event_id", F.round(F.abs("value") % 10, 6).alias("v"))
    step = F.format_string("step %4d/10: train loss %9.6f (x)", F.col("event_id") - 499, F.col("v"))
    e.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.when(F.col("event_id") >= 500, step).otherwise("warm-up"))).write.text(path)
    lines = text_files.numbered(spark.read.text(path))
    return text_files.fixed_columns(lines, "step    1/10", 25, 34, 10).withColumn("value", F.round("value", 6))


@query("S30 A26", "WITH f AS (SELECT user_id % 6 AS file, event_type AS task, avg(value) AS v FROM events GROUP BY 1, 2) SELECT file, round(100 * avg(v), 4) AS score, round((SELECT avg(s) FROM (SELECT 100 * avg(v) AS s FROM f GROUP BY file)), 4) AS average FROM f GROUP BY file")
def suite_json(spark, sf_dir):
    path = scratch(spark, "suite")
    f = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).alias("file"), "event_type").agg(F.avg("value").alias("v"))
    one = F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.concat(F.lit("m"), F.col("file").cast("string")), "v"))))
    files = f.groupBy("file").agg(F.to_json(F.struct(one.alias("results"))).alias("value"))
    files.select("value").repartition(6, "value").write.option("maxRecordsPerFile", 1).text(path)
    r = text_files.suite_results(spark, path).withColumn("file", F.substring("metric", 2, 9).cast("long"))
    s = text_files.suite_scores(r, F.concat(F.lit("m"), F.col("file").cast("string")))
    return s.crossJoin(F.broadcast(s.agg(F.avg("score").alias("average")))).select("file", F.round("score", 4).alias("score"), F.round("average", 4).alias("average"))  # one row


LABELS = {"residual": 0, "error": 1, "time": 2, "flops": 3}


@query("S27", "SELECT event_id AS line, " + ", ".join(f"CASE WHEN event_id % 4 = {i} THEN round(value, 4) END AS {k}" for k, i in LABELS.items()) + " FROM events")
def stdout_values(spark, sf_dir):
    path = scratch(spark, "stdout")
    e = table(spark, sf_dir, "events").select("event_id", F.round("value", 4).alias("v"))
    name = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % 4 + 1).cast("int"))
    e.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.concat(name, F.lit("   : "), F.coalesce(F.col("v").cast("string"), F.lit("-"))))).write.text(path)
    lines = text_files.numbered(spark.read.text(path))
    return lines.select("line", *[telemetry.labelled_value(F.col("text"), k).alias(k) for k in LABELS])


@query("S26", "SELECT user_id % 3 AS file, event_type AS key, round(sum(value), 3) AS total FROM events WHERE event_type <> 'click' GROUP BY 1, 2")
def keys_of_first_file(spark, sf_dir):
    path = scratch(spark, "metrics")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("file"), "event_id", "event_type", "value").where("file > 0 or event_type <> 'click'")
    e.select("file", F.concat(F.lit("@"), "event_type", F.lit(" : "), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit(" ms@")).alias("value")).write.partitionBy("file").text(path)
    key, value = telemetry.metric_line(F.col("value"))
    lines = spark.read.text(path).select(F.col("file").cast("long").alias("file"), telemetry.metric_key(F.col("value")).alias("key"), value.alias("v"))
    return text_files.keys_of_first_file(lines.where("key is not null")).groupBy("file", "key").agg(F.round(F.sum("v"), 3).alias("total"))


@query("K12 S25 ST5", "SELECT event_id % 400 AS step, CAST(event_id % 3 AS BIGINT) AS stream, arg_max(round(value, 4), event_id) AS value FROM events GROUP BY 1, 2")
def appended_log(spark, sf_dir):
    """Two appends to one log, with steps that are replayed; the last line of a step counts."""
    path = scratch(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 400).alias("step"), (F.col("event_id") % 3).alias("s"), F.round("value", 4).alias("v"))
    names = F.element_at(F.array(*map(F.lit, ("trl", "tel", "eval"))), (F.col("s") + 1).cast("int"))
    line = F.concat_ws("\t", F.col("event_id").cast("string"), F.concat(F.lit("s:"), F.col("step").cast("string"), F.lit(" "), names, F.lit(":"), F.col("v").cast("string")))
    for k in range(2):
        text_files.append_log(e.where(F.col("event_id") % 2 == k).select(line), path)
    lines = text_files.numbered(spark.read.text(path))
    step, name, value = telemetry.step_and_stream(F.col("text"))
    rows = lines.select("line", step.alias("step"), name.alias("name"), value.alias("value"))
    stream = F.array_position(F.array(*map(F.lit, ("trl", "tel", "eval"))), F.col("name")) - 1
    return text_files.last_of(rows, ["step", "name"], "line").select("step", stream.cast("long").alias("stream"), "value")


#: Words as pieces of 63 characters at most, which 255 bytes hold.
PIECE = "(?s).{1,63}"
PIECES = f"SELECT conv_id, turn, unnest(regexp_extract_all(w, '{PIECE}')) AS w FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> ''"


@query("S22 K16 P12", f"WITH t AS ({PIECES}), v AS (SELECT w, row_number() OVER (ORDER BY encode(w)) - 1 AS id FROM (SELECT DISTINCT w FROM t)) SELECT conv_id, turn, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(CASE WHEN strlen(w) > 1 OR regexp_matches(w, '^[ -~]$') THEN strlen(w) ELSE 0 END) AS BIGINT) AS shown FROM t JOIN v USING (w) GROUP BY 1, 2")
def tokenizer_table(spark, sf_dir):
    """A vocabulary of whole words written as tokenizer tables and read as rows; texts as its ids, and back to pieces by a join."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w"))
    words = words.select("conv_id", "turn", F.explode(F.regexp_extract_all("w", F.lit(PIECE), F.lit(0))).alias("w")).where("w <> ''")
    piece = F.encode("w", "UTF-8")
    path = scratch(spark, "vocabulary")
    binary_files.write_tokenizer(accumulated(words.select(piece.alias("piece")).distinct(), ["piece"]), path)
    vocabulary = binary_files.read_tokenizer(spark, path)
    ids = words.join(vocabulary, piece == F.col("piece")).select("conv_id", "turn", "id")
    back = ids.join(vocabulary, "id")
    shown = F.when(F.col("printable"), F.octet_length("piece")).otherwise(0)
    return back.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(shown).cast("long").alias("shown"))


@query("S14 K06 A17", "SELECT doc_id AS idx, CAST(quality AS BIGINT) AS label, CAST(3 + doc_id % 5 AS BIGINT) AS ctx, CAST(c AS BIGINT) AS choice, CAST(1 + (doc_id + c) % 4 AS BIGINT) AS n, CAST((1 + (doc_id + c) % 4) * (doc_id % 1000 + c) AS BIGINT) AS sum FROM labels, (SELECT unnest(range(0, 4)) AS c)")
def evaluation_file(spark, sf_dir):
    """Examples written as evaluation files by the executors and read as a row for each ending."""
    d = F.col("doc_id")
    ending = lambda c: F.array_repeat(d % 1000 + c, (1 + (d + c) % 4).cast("int"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label"), F.array_repeat(F.lit(7).cast("long"), (3 + d % 5).cast("int")).alias("context"), F.array(*map(ending, range(4))).alias("endings"))
    rows = stored(accumulated(rows, ["doc_id"]), "examples")
    path = scratch(spark, "evaluation")
    binary_files.write_examples(rows, path)
    e = binary_files.read_examples(spark, path)
    flat = e.join(rows.select(F.col("_k").alias("i"), F.col("doc_id").alias("idx")), "i").select("idx", "label", F.size("context").cast("long").alias("ctx"), F.posexplode("endings").alias("choice", "ending"))
    return flat.select("idx", "label", "ctx", F.col("choice").cast("long").alias("choice"), F.size("ending").cast("long").alias("n"), F.aggregate("ending", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum"))


def _tensors() -> dict[str, int]:
    return binary_files.tensor_sizes(8, 64, 2, 16)


@query("S20 K09 E17", "SELECT CAST(v AS BIGINT) AS version, t AS tensor, CAST(n AS BIGINT) AS n, CAST(first AS BIGINT) AS first FROM (VALUES " + ", ".join(f"('{k}', {n}, {sum(list(_tensors().values())[:i])})" for i, (k, n) in enumerate(_tensors().items())) + ") x(t, n, first), (SELECT unnest([3, 5]) AS v)")
def checkpoint_roundtrip(spark, sf_dir):
    """A model's tensors written as full and as half width and read by byte ranges: values of each, the first of which is their offset."""
    out = None
    sizes = _tensors()
    for version in (3, 5):
        values = np.concatenate([np.concatenate([[at], np.full(n - 1, 0.5)]) for at, n in zip(np.cumsum([0, *sizes.values()]), sizes.values())])
        path = f"{scratch(spark, 'checkpoint')}/model.bin"
        if version == 5:  # offsets as multiples that half width holds: their place in the file is told by the count
            values = np.minimum(values, 256.0)
        binary_files.put(path, binary_files.encode_checkpoint(values, 8, 61, 2, 2, 16, 64, version))
        t = binary_files.read_checkpoint(spark, path, chunk=1000).groupBy("tensor").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("idx") == 0, F.col("val"))).cast("long").alias("first"))
        starts = spark.createDataFrame(list(zip(sizes, np.cumsum([0, *sizes.values()]).tolist())), "tensor string, at long")
        t = t.join(F.broadcast(starts), "tensor").where("first = least(at, 256)" if version == 5 else "first = at")  # sixteen rows
        t = t.select(F.lit(version).cast("long").alias("version"), "tensor", "n", F.col("at").alias("first"))
        out = t if out is None else out.unionByName(t)
    return out


@query("S13", "SELECT CAST(shard AS BIGINT) AS shard, n, n >= 4 * 64 + 1 AS enough FROM (SELECT o_custkey % 40 AS shard, count(*) AS n FROM orders GROUP BY 1)")
def shard_minimum(spark, sf_dir):
    """Shards that are too short for one batch of all ranks are told."""
    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    from ..operators import tokens

    return tokens.enough(n, 4, 64, 1)


REPORT = (("mesh.nx", "32"), ("mesh.ny", "16"), ("solver.iterations", "149"), ("solver.residual", "1e-09"), ("time.total", "2.5"))


@query("K02", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(["run:", "  mesh:", "    nx: 32", "    ny: 16", "  solver:", "    iterations: 149", "    residual: 1e-09", "  time:", "    total: 2.5"])) + ") t(line, text)")
def yaml_report(spark, sf_dir):
    """A run's figures as nested lines."""
    return telemetry.report_lines(spark.createDataFrame(list(REPORT), "path string, value string").withColumn("i", F.monotonically_increasing_id()), "run")
