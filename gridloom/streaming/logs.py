"""Run logs as streams: the last line of a step wins however late it comes; a moving average by recurrence.

After a crash a run writes lines of earlier steps again, and files of several writers come in any order. A line is told by
its number: of the lines of one (stream, step), that of the largest number counts, whatever came first. State is a
map from steps to lines for each stretch of STEPS steps of a stream, so no key gathers a whole stream.

The average of a series keeps (steps, value) and is given, corrected for its start, with every row; the first row of a
series is left out of it, as in the batch form. Micro-batches of a series come in order, rows of one in any. Series are
dealt to BUCKETS keys by hash, each with one state of all its series, read and written once a micro-batch.

Null streams, steps and series are keys of their own. State lies in RocksDB, which transformWithState asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Steps whose lines one key holds.
STEPS = 1000
#: Keys that series of averages are dealt to.
BUCKETS = 1024


def with_store(spark: SparkSession) -> None:
    """Streams that start after this keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _LastLines(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "step string", "line long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for part in rows:
            for step, line, value in zip(part["step"].tolist(), part["line"].tolist(), part["value"].tolist()):
                if step not in best or line > best[step][0]:
                    best[step] = (line, value)
        out = []
        for step, (line, value) in best.items():
            if not self.lines.containsKey((step,)) or self.lines.getValue((step,))[0] < line:
                self.lines.updateValue((step,), (line,))
                out.append((key[0], step, line, value))
        if out:
            yield pd.DataFrame(out, columns=["stream", "step", "line", "value"])

    def close(self) -> None:
        pass


def last_lines(lines: DataFrame, stream: str, step: str, line: str, value: str) -> DataFrame:
    """(stream, step, line, value) as they change: a row each time a line of a larger number has come."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kinds = dict(lines.dtypes)
    d = lines.select(F.col(stream).cast("string").alias("stream"), F.coalesce(F.floor(F.col(step) / STEPS).cast("long"), F.lit(-(1 << 62))).alias("stretch"), text(step).alias("step"), F.col(line).cast("long").alias("line"), F.col(value).cast("double").alias("value"))
    out = d.groupBy("stream", "stretch").transformWithStateInPandas(_LastLines(), "stream string, step string, line long, value double", "Update", "None")
    return out.select(F.col("stream").alias(stream), F.nullif("step", F.lit("")).cast(kinds[step]).alias(step), "line", "value")


class _Averages(StatefulProcessor):
    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {s: (seen, total) for s, seen, total in json.loads(self.held.get()[0])} if self.held.exists() else {}
        every = pd.concat(list(rows)).sort_values("at", kind="stable")
        names = [s if isinstance(s, str) else None for s in every["series"].tolist()]  # a null series is one of its own
        steps, ema = [], []
        for s, v in zip(names, every["value"].tolist()):
            seen, total = held.get(s, (-1, 0.0))
            seen += 1
            if seen:
                total = self.keep * total + (1 - self.keep) * v
            held[s] = (seen, total)
            steps.append(seen)
            ema.append(total / (1 - self.keep**seen) if seen else None)
        self.held.update((json.dumps([(s, *x) for s, x in held.items()]).encode(),))
        yield pd.DataFrame({"series": pd.Series(names, dtype="object"), "at": every["at"].to_numpy(), "steps": steps, "ema": pd.Series(ema, dtype="float64")})

    def close(self) -> None:
        pass


def averages(rows: DataFrame, series: str, order: str, value: str, keep: float = 0.95) -> DataFrame:
    """(series, order, steps, ema): the corrected average after each row, over `steps` values; null for the first."""
    kinds = dict(rows.dtypes)
    d = rows.select(F.col(series).cast("string").alias("series"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("value"))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(BUCKETS)))
    out = d.groupBy("bucket").transformWithStateInPandas(_Averages(keep), "series string, at long, steps long, ema double", "Append", "None")
    return out.select(F.col("series").cast(kinds[series]).alias(series), F.col("at").alias(order), "steps", F.when(F.col("steps") > 0, F.col("ema")).alias("ema"))
