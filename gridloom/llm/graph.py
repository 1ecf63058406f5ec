"""Connected components of an edge table, without collecting links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a few numbers up to which a table is broadcast to a join; larger ones are shuffled.
SMALL = 500_000


def unused(df: DataFrame, name: str) -> str:
    """name, or the first longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, what: str, *more) -> tuple[DataFrame, int, list]:
    """df as a stored table, its rows, and what the aggregates `more` give, told by the writing itself."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(more)]), what)
    got = seen.get
    return out, int(got["n"]), [got[f"m{i}"] for i in range(len(more))]


def light(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: broadcast where it has SMALL rows at most, shuffled beyond."""
    return F.broadcast(df) if rows <= SMALL else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, int]:
    """(node, component) for each node of an edge, and how many rows these are: component is the
    smallest node reachable.

    Alternates large-star and small-star steps: every node hands its larger neighbours to the
    smallest one it sees, then its smaller ones, until the edges form stars. Minima are aggregated
    before they are shuffled, so a hub's neighbours never meet in one task as a list; where a table of
    minima isn't small the join with it is one whose hot keys adaptive execution splits. An empty
    table gives an empty one; loops and repeated edges do no harm.
    """
    e, n, last = *sized(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")[:2], None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u link to the smallest node near u
        e = both.join(light(low, 2 * n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, link to the smallest of them
        small = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        e = small.join(light(low, 2 * n), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        e, n, now = sized(e, "edges", F.bit_xor(F.xxhash64("u", "v")))
        if [n, *now] == last:
            break
        last = [n, *now]
    star = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return sized(star.unionByName(roots), "components")[:2]
