"""Queries over run logs and series, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as t
from ..session import table
from .catalog import query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts"), "user_id", "event_type", "value", "props")


@query("W06 ST1", "SELECT event_id, event_type, round(CASE WHEN k > 128 THEN CASE WHEN d = 0 THEN 0 ELSE (value - m) / d END END, 6) AS z FROM (SELECT event_id, event_type, value, avg(value) OVER f AS m, stddev_pop(value) OVER f AS d, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WINDOW f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW))")
def zscore_outliers(spark, sf_dir):
    return t.sliding_zscore(_events(spark, sf_dir), "value", ["event_id"], ["event_type"]).select("event_id", "event_type", F.round("z", 6).alias("z"))


@query("W08 ST2", "WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS b FROM events) SELECT user_id, count(*) AS steps, round(sum(0.05::DOUBLE * pow(0.95::DOUBLE, b) * value) / (1 - pow(0.95::DOUBLE, count(*))), 6) AS ema FROM k WHERE k > 1 GROUP BY user_id")
def ema_throughput(spark, sf_dir):
    return t.bias_corrected_ema(_events(spark, sf_dir), "value", ["event_id"], ["user_id"]).select("user_id", "steps", F.round("ema", 6).alias("ema"))


@query("W09", "WITH k AS (SELECT event_id, event_type, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n, first_value(value) OVER w AS a, last_value(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_id, round((s + greatest(0, 4 - k) * a + greatest(0, k + 3 - n) * z) / 7, 6) AS avg FROM k")
def moving_average(spark, sf_dir):
    return t.moving_average(_events(spark, sf_dir), "value", ["event_id"], ["event_type"], 3).select("event_id", F.round("avg", 6).alias("avg"))


RUNS = "(SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS it, value AS ms FROM events)"


def _runs(spark, sf_dir):
    return t.numbered(_events(spark, sf_dir), ["event_id"], ["user_id"]).select(F.col("user_id").alias("run"), F.col("_k").alias("it"), F.col("value").alias("ms"))


@query("A18 O09", f"SELECT run, max(CASE WHEN it = 0 THEN ms END) AS iter0, max(CASE WHEN it = 1 THEN ms END) AS iter1, round(avg(CASE WHEN it >= 2 THEN ms END), 6) AS mean, round(CASE WHEN count(CASE WHEN it >= 2 THEN ms END) > 1 THEN stddev_samp(CASE WHEN it >= 2 THEN ms END) ELSE 0 END, 6) AS stddev FROM {RUNS} GROUP BY run")
def iter_stats(spark, sf_dir):
    return t.steady_state(_runs(spark, sf_dir), ["run"], "it", "ms").select("run", "iter0", "iter1", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@query("A19", f"SELECT it, round(avg(ms), 6) AS mean, round(stddev_pop(ms), 6) AS dev FROM {RUNS} GROUP BY it")
def iterations_across_runs(spark, sf_dir):
    return t.across_runs(_runs(spark, sf_dir), "it", "ms").select("it", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"))


@query("A20", f"SELECT run, it // 4 AS chunk, max(ms) AS max, round(sum(ms), 6) AS sum FROM {RUNS} GROUP BY 1, 2")
def chunk_stats(spark, sf_dir):
    return t.chunk_stats(_runs(spark, sf_dir), "ms", "it", 4, ["run"]).withColumn("sum", F.round("sum", 6))


@query("A25 ST5", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_write_wins(spark, sf_dir):
    return t.last_write(_events(spark, sf_dir), ["user_id", "event_type"], "value", "event_id")


@query("A25", "SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_per_group(spark, sf_dir):
    return t.first_write(_events(spark, sf_dir), ["user_id", "event_type"], "value", "event_id")


@query("A22", "SELECT event_type, bucket, CAST(grouping_id(event_type, bucket) AS BIGINT) AS level, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events), 8) AS share FROM (SELECT event_type, user_id % 4 AS bucket, value FROM events) GROUP BY GROUPING SETS ((event_type), (bucket), ())")
def profile_rollup(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("bucket", F.col("user_id") % 4)
    return t.rollup_share(e, "event_type", "bucket", "value").withColumns({"total": F.round("total", 4), "share": F.round("share", 8)})


@query("A23", "SELECT user_id % 8 AS rank, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def rank_min_max_avg(spark, sf_dir):
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("rank")).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("W12", "SELECT event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS us FROM events")
def iteration_times(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.since_last(_events(spark, sf_dir).select("event_id", "user_id", at.alias("at")), "at", ["event_id"], ["user_id"]).select("event_id", F.col("since").alias("us"))


@query("S25", "SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN 'trl' ELSE 'tel' END AS stream, round(value, 4) AS value, event_type AS key FROM events")
def log_lines_parsed(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.round("value", 4))
    stream = F.when(F.col("event_id") % 2 == 0, "trl").otherwise("tel")
    lines = e.select(F.concat(F.lit("s:"), "event_id", F.lit(" "), stream, F.lit(":"), "v", F.lit(" lr:0.1")).alias("line"), F.concat(F.lit("@"), "event_type", F.lit(" : "), "v", F.lit(" ms@")).alias("metric"))
    step, name, value = t.step_and_stream(F.col("line"))
    key, _ = t.metric_line(F.col("metric"))
    return lines.select(step.alias("step"), name.alias("stream"), value.alias("value"), key.alias("key"))


@query("", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("K14", "SELECT user_id % 8 AS run, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even, sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS odd FROM events GROUP BY 1")
def flipped_metrics(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.col("user_id") % 8).alias("run"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("file"))
    return e.groupBy("run").pivot("file", ["even", "odd"]).count().na.fill(0)


@query("J15", "SELECT o_orderkey, expected, actual FROM (SELECT o_orderkey, o_totalprice AS expected, (SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS actual FROM orders) WHERE actual IS NULL OR abs(expected - actual) > 1000.5")
def tolerance_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    return t.tolerance_mismatches(o, s.join(o.select("o_orderkey"), "o_orderkey", "left_semi"), "o_orderkey", "v", 1000.5)


@query("A26", "SELECT event_type AS task, round(100 * avg(value), 5) AS score, round((SELECT avg(s) FROM (SELECT 100 * avg(value) AS s FROM events GROUP BY event_type)), 5) AS overall FROM events GROUP BY event_type")
def suite_score(spark, sf_dir):
    s = _events(spark, sf_dir).groupBy(F.col("event_type").alias("task")).agg((100 * F.avg("value")).alias("s"))
    return s.crossJoin(F.broadcast(s.agg(F.avg("s").alias("o")))).select("task", F.round("s", 5).alias("score"), F.round("o", 5).alias("overall"))  # one row


@query("T03 T04 T05", "SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS BIGINT) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def buckets_by_size(spark, sf_dir):
    from pyspark.sql import Window

    n = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long"))


@query("S24 K13", "SELECT user_id AS run, value AS avg_ms, CAST(event_id % 3 AS BIGINT) AS returncode FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL")
def sweep_csv(spark, sf_dir):
    from ..session import scratch

    path = scratch(spark, "sweep")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("value").alias("avg_ms"), (F.col("event_id") % 3).alias("returncode"))
    rows.write.csv(path, header=True)
    back = spark.read.schema("run long, avg_ms string, returncode string").csv(path, header=True)
    good = back.where(F.col("returncode").isin("0", "0.0") & F.col("avg_ms").isNotNull() & (F.col("avg_ms") != ""))
    return good.select("run", F.col("avg_ms").cast("double").alias("avg_ms"), F.col("returncode").cast("double").cast("long").alias("returncode"))
