"""Analytics over run logs: steady-state statistics, detectors, roll-ups, log parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BLOCK, accumulated


def numbered(df: DataFrame, order: list[str], partition: list[str], block: int = BLOCK) -> DataFrame:
    """df with _k, the row's number in its series from 0, and _n, the series' rows; nulls come first."""
    return accumulated(df, order, partition, block=block)


def with_margins(df: DataFrame, partition: list[str], before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(rows, window columns) of `numbered` rows: blocks of a series, each with `before` rows of the block before and
    `after` of the one behind, marked by _own = false. A frame of that many rows needs no other block."""
    block = max(block, before, after)
    home, at = F.floor(F.col("_k") / block), F.col("_k") % block
    copies = F.array(F.struct(home.alias("_p"), F.lit(True).alias("_own")), F.when(at >= block - before, F.struct((home + 1).alias("_p"), F.lit(False).alias("_own"))), F.when(at < after, F.struct((home - 1).alias("_p"), F.lit(False).alias("_own"))))
    out = df.withColumn("_x", F.explode(F.filter(copies, lambda x: x.isNotNull()))).select("*", "_x._p", "_x._own").drop("_x")
    return out, [*partition, "_p"]


def sliding_zscore(df: DataFrame, value: str, order: list[str], partition: list[str], window: int = 128, block: int = BLOCK) -> DataFrame:
    """z: distance from the mean of the last `window` values, the current one included, in population
    deviations; null for the first `window` rows of a series, 0 where the deviation is 0. A long series is
    run in blocks that carry the rows before them along."""
    rows, by = with_margins(numbered(df, order, partition, block), partition, window - 1, 0, block)
    frame = Window.partitionBy(*by).orderBy("_k").rowsBetween(1 - window, 0)
    mean, dev = F.avg(value).over(frame), F.stddev_pop(value).over(frame)
    z = F.when(dev == 0, 0.0).otherwise((F.col(value) - mean) / dev)
    return rows.withColumn("z", F.when(F.col("_k") >= window, z)).where("_own").drop("_k", "_n", "_p", "_own")


def bias_corrected_ema(df: DataFrame, value: str, order: list[str], partition: list[str], keep: float = 0.95, block: int = BLOCK) -> DataFrame:
    """ema at the last step of each series: keep/(1-keep) smoothing with bias correction, the first
    step left out. Closed form: weights fall by `keep` from the last step back, so a series is one sum
    over numbered rows, whichever task has them."""
    d = numbered(df, order, partition, block).where("_k > 0")
    weight = (1 - keep) * F.pow(F.lit(keep), F.col("_n") - 1 - F.col("_k"))
    s = d.groupBy(*partition).agg(F.sum(weight * F.col(value)).alias("_s"), F.count(F.lit(1)).alias("steps"))
    return s.select(*partition, "steps", (F.col("_s") / (1 - F.pow(F.lit(keep), F.col("steps")))).alias("ema"))


def moving_average(df: DataFrame, value: str, order: list[str], partition: list[str], half: int, block: int = BLOCK) -> DataFrame:
    """avg: centred mean over 2 half + 1 rows; beyond the ends the end values count again. A long series is run in
    blocks that carry the rows on either side along."""
    n = numbered(df, order, partition, block)
    ends = n.where((F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1)).groupBy(*[F.col(c).alias(f"_{c}") for c in partition])
    ends = ends.agg(F.min_by(value, "_k").alias("_first"), F.max_by(value, "_k").alias("_last"))  # one row a series
    same = F.lit(True)
    for c in partition:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows, by = with_margins(n.join(ends, same).drop(*[f"_{c}" for c in partition]), partition, half, half, block)
    frame = Window.partitionBy(*by).orderBy("_k").rowsBetween(-half, half)
    k = F.col("_k") + 1
    total = F.sum(value).over(frame) + F.greatest(F.lit(0), half + 1 - k) * F.col("_first") + F.greatest(F.lit(0), k + half - F.col("_n")) * F.col("_last")
    return rows.withColumn("avg", total / (2 * half + 1)).where("_own").drop("_k", "_n", "_p", "_own", "_first", "_last")


def since_last(df: DataFrame, at: str, order: list[str], partition: list[str], block: int = BLOCK) -> DataFrame:
    """since: what `at` has grown by since the row before; null for the first of a series."""
    rows, by = with_margins(numbered(df, order, partition, block), partition, 1, 0, block)
    return rows.withColumn("since", F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy("_k"))).where("_own").drop("_k", "_n", "_p", "_own")


def steady_state(df: DataFrame, by: list[str], it: str, ms: str) -> DataFrame:
    """First two iterations, then mean and sample deviation of those from 2 on (0 for a single one)."""
    late = F.when(F.col(it) >= 2, F.col(ms))
    return df.groupBy(*by).agg(F.max(F.when(F.col(it) == 0, F.col(ms))).alias("iter0"), F.max(F.when(F.col(it) == 1, F.col(ms))).alias("iter1"), F.avg(late).alias("mean"), F.when(F.count(late) > 1, F.stddev_samp(late)).otherwise(0.0).alias("stddev"))


def across_runs(df: DataFrame, it: str, ms: str) -> DataFrame:
    """Per iteration the mean and population deviation across runs."""
    return df.groupBy(it).agg(F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("dev"))


def chunk_stats(df: DataFrame, value: str, pos: str, size: int, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col(pos) / size).alias("chunk")).agg(F.max(value).alias("max"), F.sum(value).alias("sum"))


def last_write(df: DataFrame, by: list[str], value: str, line: str) -> DataFrame:
    """After a replay the later line of a key counts."""
    return df.groupBy(*by).agg(F.max_by(value, line).alias(value))


def first_write(df: DataFrame, by: list[str], value: str, line: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, line).alias(value))


def rollup_share(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Totals by first, by second and over all, with the share of the whole."""
    g = df.groupingSets([[first], [second], []], first, second).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    whole = df.agg(F.sum(value).alias("whole"))
    return g.crossJoin(F.broadcast(whole)).select(first, second, "level", "n", "total", (F.col("total") / F.col("whole")).alias("share"))  # one row


def labelled_value(text: Column, label: str) -> Column:
    """The number after `label :` in a line, or null."""
    return F.regexp_extract(text, rf"{label}\s*:\s*([-+0-9.eE]+)", 1).try_cast("double")


def step_and_stream(text: Column) -> tuple[Column, Column, Column]:
    """(step, stream, value) of a line `s:<step> <stream>:<value> ...`: the first stream counts."""
    p = r"^s:(\d+) ([a-z]+):([-+0-9.eE]+)"
    return F.regexp_extract(text, p, 1).try_cast("bigint"), F.nullif(F.regexp_extract(text, p, 2), F.lit("")), F.regexp_extract(text, p, 3).try_cast("double")


def metric_line(text: Column) -> tuple[Column, Column]:
    """(key, value) of a line `@key : value ms@`."""
    p = r"^@([^:@]+?)\s*:\s*([-+0-9.eE]+)(?: ms)?@"
    return F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.regexp_extract(text, p, 2).try_cast("double")


def tolerance_mismatches(expected: DataFrame, actual: DataFrame, key: str, value: str, eps: float) -> DataFrame:
    """Rows of either side whose values differ by more than eps or that the other side lacks."""
    e = expected.select(key, F.col(value).alias("expected"))
    a = actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full").where("expected is null or actual is null or abs(expected - actual) > " + repr(eps))


def metric_key(text: Column) -> Column:
    """The key of a line `@key : ...@`, whether or not a number follows."""
    return F.nullif(F.regexp_extract(text, r"^@([^:@]+?)\s*:", 1), F.lit(""))


def kernel_pass(name: Column) -> Column:
    """The part of a training step that a kernel belongs to."""
    return F.when(name.contains("encoder"), "enc").when(name.contains("classifier"), "cls").when(name.contains("adamw") | name.contains("global_norm") | name.contains("copy_and_cast"), "opt").otherwise("layer")


def kernel_function(name: Column) -> Column:
    """A kernel's name without arguments, return type and template; those of one matrix product together."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\(.*", ""), r"^[a-z]+ ", ""), "<.*", "")
    return F.when(bare.startswith("ampere_bf16"), "ampere_bf16").otherwise(bare)


def report_lines(figures: DataFrame, title: str) -> DataFrame:
    """(line, text): figures (i, path of two names, value) as nested lines under a title; a group's name
    stands before its first figure. Reports are short."""
    parts = F.split("path", r"\.")
    f = figures.select("i", parts[0].alias("group"), parts[1].alias("name"), "value")
    heads = f.groupBy("group").agg(F.min("i").alias("i")).select("i", F.lit(0).alias("k"), F.concat(F.lit("  "), "group", F.lit(":")).alias("text"))
    leaves = f.select("i", F.lit(1).alias("k"), F.concat(F.lit("    "), "name", F.lit(": "), "value").alias("text"))
    top = figures.sparkSession.createDataFrame([(-1, 0, f"{title}:")], "i long, k int, text string")
    every = top.unionByName(heads).unionByName(leaves)
    return every.select((F.row_number().over(Window.orderBy("i", "k")) - 1).cast("long").alias("line"), "text")


def figures_of_merit(runs: DataFrame) -> DataFrame:
    """runs (seconds, cycles, side, ranks) with what a finished run reports: grind, microseconds for an element and a cycle of one
    rank's cube, overall, the same for all ranks' elements, and fom, thousands of elements a second. Null where a divisor is 0."""
    cycle = F.try_divide(F.col("seconds") * 1e6, F.col("cycles"))
    own = F.col("side").cast("double") ** 3
    overall = F.try_divide(cycle, own * F.col("ranks"))
    return runs.withColumns({"grind": F.try_divide(cycle, own), "overall": overall, "fom": F.try_divide(F.lit(1000.0), overall)})
