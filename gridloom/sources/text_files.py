"""Readers of the text formats that evaluation sets, run logs and profilers come in.

All go through Spark's own readers, so any store that Spark reads will do, files are split where the
format allows it, and a field that can't be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXAMPLE = "ind long, ctx string, label int, endings array<string>"


def examples(spark: SparkSession, uri: str, schema: str = EXAMPLE) -> DataFrame:
    """Multiple-choice examples, one JSON object a line."""
    return spark.read.schema(schema).json(uri)


def stories(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """Shards that are one JSON array each: a file is read whole by one task."""
    return spark.read.schema(schema).option("multiLine", True).json(uri)


def letter_questions(spark: SparkSession, uri: str) -> DataFrame:
    """(question, endings, label) of headerless rows question, A, B, C, D, letter."""
    rows = spark.read.schema("question string, a string, b string, c string, d string, letter string").option("escape", '"').option("multiLine", True).csv(uri)
    return rows.select("question", F.array("a", "b", "c", "d").alias("endings"), (F.ascii("letter") - 65).alias("label"))


def whole_sections(spark: SparkSession, uri: str) -> DataFrame:
    """(path, i, section): each file's text cut at empty lines; all but its last section keep them."""
    from ..operators.tokens import sections

    text = spark.read.text(uri, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(sections(F.col("value"))).alias("i", "section"))


def profile(spark: SparkSession, uri: str, kernel: str, numbers: list[str]) -> DataFrame:
    """Rows of a profiler's CSV: a header, a row of units, then data. A row is data if its `id` is a number."""
    rows = spark.read.option("header", True).csv(uri)
    return rows.where(F.col("id").try_cast("bigint").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(kernel).alias("kernel"), *[F.col(n).try_cast("double").alias(n) for n in numbers])


def fixed_columns(lines: DataFrame, marker: str, begin: int, end: int, most: int) -> DataFrame:
    """(line, value): the number at characters begin to end - 1 of `most` lines from the first that holds marker.
    lines: (line number, text)."""
    first = lines.where(F.contains("text", F.lit(marker))).agg(F.min("line").alias("first"))
    near = lines.crossJoin(F.broadcast(first)).where((F.col("line") >= F.col("first")) & (F.col("line") < F.col("first") + most))  # one row
    return near.select("line", F.trim(F.substring("text", begin + 1, end - begin)).try_cast("double").alias("value"))


def suite_results(spark: SparkSession, uri: str) -> DataFrame:
    """(file, task, metric, value) of result files {"results": {task: {metric: value}}}."""
    text = spark.read.text(uri, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "results map<string, map<string, double>>").alias("r"))
    tasks = text.select("file", F.explode("r.results").alias("task", "metrics"))
    return tasks.select("file", "task", F.explode("metrics").alias("metric", "value"))


def suite_scores(results: DataFrame, metric: Column) -> DataFrame:
    """(file, score): the mean of a file's chosen metric over its tasks, in hundredths."""
    return results.where(F.col("metric") == metric).groupBy("file").agg((100 * F.avg("value")).alias("score"))


def keys_of_first_file(metrics: DataFrame) -> DataFrame:
    """metrics (file, key, ...) with the keys that the first file has."""
    first = metrics.agg(F.min("file").alias("file"))
    keys = metrics.join(F.broadcast(first), "file").select("key").distinct()  # one row; a file's keys
    return metrics.join(keys, "key", "left_semi")


def numbered(lines: DataFrame, text: str = "value") -> DataFrame:
    """(file, line, text) of lines that carry their own number before a tab: text files have no order of rows."""
    parts = F.split(text, "\t", 2)
    return lines.select(parts[0].cast("long").alias("line"), parts[1].alias("text"))


def append_log(lines: DataFrame, uri: str) -> None:
    """Lines added to a log folder; a task that runs again leaves its lines once."""
    lines.write.mode("append").text(uri)


def last_of(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """After a replay the later line of a key counts."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return lines.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
