"""Queries that run as streams over the given tables, stopped and started again on the way."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as tk
from ..session import scratch, stored, table
from ..sources import token_shards
from ..streaming import logs, token_loader
from .catalog import query
from .training import SHARD, _pieces


def _until(q, batches: int | None) -> None:
    """Lets a stream run until nothing comes, or through so many micro-batches, and stops it."""
    try:
        if batches is None:
            q.processAllAvailable()
        while batches is not None and q.isActive and (q.lastProgress or {"batchId": -1})["batchId"] + 1 < batches and not (q.status["message"] == "Waiting for data to arrive" and q.lastProgress):
            time.sleep(0.05)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()


def _broken_run(df: DataFrame, mode: str, after: int = 1) -> DataFrame:
    """What a stream writes that is stopped after some micro-batches and started again from its log."""
    spark, path, log = df.sparkSession, scratch(df.sparkSession, "stream"), scratch(df.sparkSession, "stream-log")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again replaces itself

    for batches in (after, None):
        _until(df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", log).start(), batches)
    return spark.read.schema(df.schema).parquet(path)


def _in_parts(spark: SparkSession, df: DataFrame, part, parts: int) -> DataFrame:
    """df as a stream of files, one part of its rows a micro-batch, in the order of `part`."""
    path = scratch(spark, "arriving")
    for i in range(parts):
        df.where(part == i).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("ST4 P05 P14 X03", f"""WITH t AS ({SHARD}), n AS (SELECT shard, count(*) AS n, (count(*) - 1) // 1024 AS k FROM t GROUP BY shard), b AS (SELECT shard, k, coalesce(sum(k) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(k) OVER () AS whole FROM n WHERE k > 0),
r AS (SELECT b.base + t.pos // 1024 AS step, whole, t.pos % 1024 // 512 AS rank, t.pos % 512 // 128 AS row, sum(t.tok) AS sum, sum(t.tok * (t.pos % 128)) AS place FROM t JOIN b USING (shard) WHERE t.pos // 1024 < k GROUP BY ALL)
SELECT CAST(step + e * whole AS BIGINT) AS step, CAST(e AS BIGINT) AS epoch, CAST(rank AS INTEGER) AS rank, CAST(row AS INTEGER) AS row, CAST(sum AS BIGINT) AS sum, CAST(place AS BIGINT) AS place FROM r, (SELECT unnest(range(0, 2)) AS e)""")
def resumed_batches(spark, sf_dir):
    """Two epochs of the documents' token shards in order, by a loader that is stopped after a trigger and started again."""
    p = stored(_pieces(spark, sf_dir), "pieces")
    sizes = p.groupBy("shard").agg(F.sum(F.size("ids")).alias("n"))
    enough = tk.enough(sizes, 4, 128, 2).where("enough").select("shard")
    path = scratch(spark, "shards")
    token_shards.write_pieces(p.join(enough, "shard"), path)
    whole = sizes.agg(F.sum(F.floor((F.col("n") - 1) / 1024))).first()[0] or 0
    steps = min(100_000, max(2000, 2 * whole // 32))  # so the triggers stay few
    got = _broken_run(token_loader.stream(spark, path, 4, 128, ranks=2, steps=steps, shuffle=False, epochs=2), "append")
    total = lambda f: F.aggregate(F.transform("inputs", f), F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("step", "epoch", "rank", "row", total(lambda x, i: x.cast("long")).alias("sum"), total(lambda x, i: x.cast("long") * i).alias("place"))


@query("ST5 A25", "SELECT event_type, user_id AS step, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def replayed_log_stream(spark, sf_dir):
    """Lines that come in a scrambled order and in parts: of each step the one of the largest number stays."""
    logs.with_store(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    arriving = _in_parts(spark, e, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3)
    changes = _broken_run(logs.last_lines(arriving, "event_type", "user_id", "event_id", "value"), "update")
    return changes.groupBy("event_type", F.col("user_id").alias("step")).agg(F.max_by("value", "line").alias("value"))


@query("ST2 W08", "WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS b FROM events) SELECT user_id, count(*) AS steps, round(sum(0.05::DOUBLE * pow(0.95::DOUBLE, b) * value) / (1 - pow(0.95::DOUBLE, count(*))), 6) AS ema FROM k WHERE k > 1 GROUP BY user_id")
def ema_stream(spark, sf_dir):
    """The moving average of each user's values by recurrence over micro-batches, at its last row."""
    logs.with_store(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    third = e.agg((F.max("event_id") + 1) / 3).first()[0] or 1
    arriving = _in_parts(spark, e, F.floor(F.col("event_id") / third), 3)
    rows = _broken_run(logs.averages(arriving, "user_id", "event_id", "value"), "append")
    last = rows.where("steps > 0").groupBy("user_id").agg(F.max_by(F.struct("steps", "ema"), "event_id").alias("x"))
    return last.select("user_id", "x.steps", F.round("x.ema", 6).alias("ema"))
