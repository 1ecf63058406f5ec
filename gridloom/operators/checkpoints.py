"""Checkpoint sets: tables of one step, whole once a marker stands beside them.

A set is a folder step_<number> with a table for each name, and a file DONE_<number> that is made when
all tables are written. A run that dies before the marker leaves a set that nobody reads; the step's next
writing replaces it. What goes away loses its marker first. All of it goes through the Hadoop file
system, so a set may lie wherever Spark reads and writes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


class CheckpointSets:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def _named(self, kind: str) -> set[int]:
        if not self.fs.exists(self.path(self.root)):
            return set()
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)))
        return {int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}_(\d+)", n))}

    def steps(self) -> dict[int, bool]:
        """Steps that anything lies there of, and whether their sets are whole."""
        done = self._named("DONE")
        return {s: s in done for s in sorted(self._named("step") | done)}

    def latest(self) -> int | None:
        """The last whole set's step."""
        return max((s for s, whole in self.steps().items() if whole), default=None)

    def write(self, step: int, tables: Tables, mark: bool = True) -> None:
        """Writes a set. Without mark it is left as a run leaves it that dies before its end."""
        self.delete(step)
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/step_{step:08d}/{name}")
        if mark:
            self.mark(step)

    def mark(self, step: int) -> None:
        """Makes the marker; a marker that is there already is an error."""
        self.fs.create(self._at(f"DONE_{step:08d}"), False).close()

    def read(self, step: int) -> Tables:
        """The tables of a whole set."""
        if not self.steps().get(step):
            raise ValueError(f"no whole checkpoint of step {step} in {self.root}")
        folder = self._at(f"step_{step:08d}")
        if not self.fs.exists(folder):
            raise ValueError(f"checkpoint of step {step} in {self.root} has a marker and no tables")
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(folder) if s.isDirectory())
        return {n: self.spark.read.parquet(f"{self.root}/step_{step:08d}/{n}") for n in names}

    def delete(self, step: int) -> None:
        """Takes a set away, its marker first: one that is half gone is not whole."""
        self.fs.delete(self._at(f"DONE_{step:08d}"), False)
        self.fs.delete(self._at(f"step_{step:08d}"), True)

    def retain(self, last: int, every: int = 0) -> list[int]:
        """Keeps the last `last` whole sets and those of steps that `every` divides, if it isn't 0; takes away the other
        whole ones, and parts that are older than the last whole set. Returns what went."""
        found = self.steps()
        whole = [s for s, w in found.items() if w]
        newest = whole[-1] if whole else -1
        keep = set(whole[len(whole) - last :] if last else whole) | {s for s in whole if every and s % every == 0}
        gone = [s for s, w in found.items() if s not in keep and (w or s < newest)]
        for s in gone:
            self.delete(s)
        return gone


def train(sets: CheckpointSets, first: Callable[[], Tables], step: Callable[[int, Tables], Tables], steps: int, every: int, last: int = 0, major: int = 0, dies_at: int | None = None) -> Tables:
    """Runs step(n, tables) for n = 1 to `steps`, from the last whole set where there is one, and writes a set after each
    `every` steps and the last one. dies_at: the step whose tables are written and whose marker isn't, where the run ends."""
    at = sets.latest()
    tables, at = (first(), 0) if at is None else (sets.read(at), at)
    for n in range(at + 1, steps + 1):
        tables = step(n, tables)
        if n % every == 0 or n == steps:
            sets.write(n, tables, mark=n != dies_at)
            if n == dies_at:
                return tables
            sets.retain(last, major)
            tables = sets.read(n)
    return tables
