"""MatrixMarket coordinate files as matrices (i, j, v) with indices from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import mirrored
from ..session import scratch

BANNER = "%%MatrixMarket matrix coordinate"
FIELDS = ("real", "integer", "pattern")
SYMMETRIES = {"general": 0, "symmetric": 1, "skew-symmetric": -1}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The matrix of a file or of a folder with one file. Pattern entries are 1; symmetric ones are
    mirrored, skew ones with the sign turned. Raises ValueError for other banners, a matrix that
    isn't square, entries out of range and a number of entries other than the header's.
    """
    lines = spark.read.text(path)
    banner = lines.where(F.startswith("value", F.lit("%%"))).first()
    words = banner[0].lower().split() if banner else []
    if len(words) != 5 or " ".join(words[:3]) != BANNER.lower() or words[3] not in FIELDS or words[4] not in SYMMETRIES:
        raise ValueError(f"not a readable coordinate matrix: {banner and banner[0]}")
    body = lines.where(~F.startswith("value", F.lit("%")) & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    pattern = words[3] == "pattern"
    # the size line comes first; of splits of a file the first one has it
    rows, columns, entries = (int(x) for x in body.first()[0])
    if rows != columns:
        raise ValueError(f"{rows} rows but {columns} columns")
    v = F.lit(1.0) if pattern else F.get("w", F.lit(2)).cast("double")
    all_ = body.select((F.get("w", F.lit(0)).cast("long") - 1).alias("i"), (F.get("w", F.lit(1)).cast("long") - 1).alias("j"), v.alias("v"), F.monotonically_increasing_id().alias("at"))
    a = all_.where("at > 0")
    n, bad = a.agg(F.count(F.lit(1)), F.count_if((F.least("i", "j") < 0) | (F.greatest("i", "j") >= rows) | F.col("v").isNull())).first()
    if bad or n != entries:
        raise ValueError(f"{n} entries of {entries}, {bad} out of range or without value")
    a = a.drop("at")
    sign = SYMMETRIES[words[4]]
    return mirrored(a, sign) if sign else a


def write(a: DataFrame, n: int, symmetry: str = "general", path: str | None = None) -> str:
    """Writes a (its lower part, if symmetric) as one file in a folder; returns the folder. Values
    have 16 digits after the point."""
    spark = a.sparkSession
    path = path or scratch(spark, "matrix-market")
    entries = a.count()
    head = spark.createDataFrame([(0, 0, 0, f"{BANNER} real {symmetry}"), (1, 0, 0, f"{n} {n} {entries}")], "part long, i long, j long, value string")
    body = a.select(F.lit(2).cast("long").alias("part"), "i", "j", F.format_string("%d %d %22.16e", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value"))
    head.union(body).repartition(1).sortWithinPartitions("part", "i", "j").select("value").write.text(path)
    return path
