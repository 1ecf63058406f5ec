"""Matrices as row files: sizes, a count for each row, the rows, and for each row its x, b and exact x.

    n nnz
    count                 n lines
    count v j v j ...     n lines
    x b xexact            n lines

Lines are numbered once over all files of a folder. The counts come first and plan the rest: they give each of `parts`
contiguous blocks of rows its entries before a value is read, and every row is held against its count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import accumulated
from ..operators.vectors import contiguous_owner
from ..session import stored

#: Lines of a file, about: what one task sorts.
LINES = 200_000


@dataclass(frozen=True)
class RowFile:
    n: int
    matrix: DataFrame  # (i, j, v, block)
    sides: DataFrame  # (i, x, b, exact, block)
    blocks: DataFrame  # (block, first, rows, entries)


def read(spark: SparkSession, path: str, parts: int = 1) -> RowFile:
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    text = spark.read.text(path).select("value", place.alias("p"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    # splits have numbers, so that no line carries a path
    splits = stored(text.select("p").distinct().select("p", F.row_number().over(Window.orderBy("p")).alias("split")), "splits")
    text = text.join(F.broadcast(splits), "p").select("value", "split", "at")
    lines = accumulated(text, ["split", "at"]).select(F.col("_k").alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))
    lines = stored(lines, "row_file")
    head = lines.where("line = 0").first()
    if head is None or len(head.w) != 2:
        raise ValueError(f"{path}: no sizes in the first line")
    n, entries = int(head.w[0]), int(head.w[1])
    body = lines.where("line > 0").select(F.floor((F.col("line") - 1) / max(n, 1)).alias("section"), ((F.col("line") - 1) % max(n, 1)).alias("i"), "w")
    word = lambda i: F.get("w", F.lit(i))
    counts = body.where("section = 0").select("i", word(0).try_cast("long").alias("count"))
    owner = contiguous_owner(F.col("i"), n, parts)
    blocks = stored(counts.groupBy(owner.alias("block")).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("rows"), F.sum("count").alias("entries")), "blocks")
    tasks = 1 + n // LINES
    rows = body.where("section = 1").repartition(tasks, "i").join(counts.repartition(tasks, "i"), "i")
    kept = F.count_if((word(0).try_cast("long") == F.col("count")) & (F.size("w") == 1 + 2 * F.col("count")))
    whole = body.agg(F.count(F.lit(1)), F.count_if((F.col("section") == 2) & (F.size("w") == 3))).first()
    right, total = rows.agg(kept, F.sum("count")).first()
    if whole[0] != 3 * n or whole[1] != n or right != n or (total or 0) != entries:
        raise ValueError(f"{path}: {n} rows and {entries} entries announced; {right} rows are as long as their counts, which make {total} entries, and {whole[1]} have right-hand sides")
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("count") - 1), lambda k: F.struct(F.get("w", (2 + 2 * k).cast("int")).try_cast("long").alias("j"), F.get("w", (1 + 2 * k).cast("int")).try_cast("double").alias("v"))))
    matrix = rows.where("count > 0").select("i", owner.alias("block"), pair.alias("e")).select("i", "e.j", "e.v", "block")
    sides = body.where("section = 2").select("i", *[word(k).try_cast("double").alias(c) for k, c in enumerate(("x", "b", "exact"))], owner.alias("block"))
    return RowFile(n, matrix, sides, blocks)


def write(matrix: DataFrame, sides: DataFrame, path: str, files: int | None = None) -> None:
    """matrix (i, j, v) and sides (i, x, b, exact) of every row from 0; a row's entries by column. Without a number
    of files there is one for each LINES lines, so that a task's share doesn't grow with the matrix."""
    rows = matrix.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))  # a row of a sparse matrix
    d = sides.join(rows, "i", "left").withColumn("count", F.coalesce(F.size("e"), F.lit(0)))
    n, entries = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    pairs = F.array_join(F.transform(F.coalesce("e", F.array()), lambda x: F.concat_ws(" ", x["v"].cast("string"), x["j"].cast("string"))), " ")
    d = stored(d.select("i", "count", F.trim(F.concat_ws(" ", F.col("count").cast("string"), pairs)).alias("row"), F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in ("x", "b", "exact")]).alias("side")), "rows")
    line = lambda section, value: d.select(F.lit(section).alias("section"), "i", F.col(value).cast("string").alias("value"))
    head = matrix.sparkSession.createDataFrame([(0, 0, f"{n} {entries}")], "section int, i long, value string")
    every = head.unionByName(line(1, "count")).unionByName(line(2, "row")).unionByName(line(3, "side"))
    every.repartitionByRange(files or -(-(3 * n + 1) // LINES), "section", "i").sortWithinPartitions("section", "i").select("value").write.text(path)
