"""Reductions and block updates that a user brings as functions of NumPy arrays.

A reduction has a state, a way to add values to one, and a way to merge two. Every task keeps a state for each key it
meets; states are merged in a tree by key and task, FAN at a time, so a key that a third of all rows has costs its
tasks' states and no more. Merging follows the tasks' numbers, so the same tasks give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: States that are merged at once, and keys that a task holds.
FAN, HELD = 64, 100_000
#: Numbers that a task's tables of states may have.
FLUSHES = 1 << 20


@dataclass(frozen=True)
class Reduction:
    #: Columns of a state, as a schema, and an empty state.
    schema: str
    zero: tuple
    #: The state with values added: arrays of the value columns, nulls left out.
    add: Callable[..., tuple]
    merge: Callable[[tuple, tuple], tuple]

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


def _log_add(state: tuple, values: np.ndarray) -> tuple:
    return _log_merge(state, (float(values.max()), float(np.exp(values - values.max()).sum()))) if len(values) else state


def _log_merge(a: tuple, b: tuple) -> tuple:
    m = max(a[0], b[0])
    return (m, sum(s * np.exp(x - m) for x, s in (a, b) if s))


#: Running maximum and the sum of exponentials below it.
ONLINE_SOFTMAX = Reduction("m double, s double", (float("-inf"), 0.0), _log_add, _log_merge)
TOTAL = Reduction("total double", (0.0,), lambda z, v: (z[0] + float(v.sum()),), lambda a, b: (a[0] + b[0],))
LARGEST = Reduction("largest double", (float("-inf"),), lambda z, v: (max(z[0], float(v.max(initial=float("-inf")))),), lambda a, b: (max(a[0], b[0]),))


def _table(keys: list[tuple], states: list[tuple], parts: Sequence[int], kinds: pa.Schema) -> pa.RecordBatch:
    rows = [(*k, *s, p) for k, s, p in zip(keys, states, parts)]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kinds)], schema=kinds)


def reduced(df: DataFrame, by: Sequence[str], values: Sequence[str], how: Reduction, fan: int = FAN, held: int = HELD) -> DataFrame:
    """(keys, state columns): one row a key, null being one; rows with a null value don't count. Without keys one row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructType

    by, n = list(by), len(by)
    types = StructType([df.schema[c] for c in by]).add("_none", IntegerType()) if not by else StructType([df.schema[c] for c in by])
    out = types
    for c in how.schema.split(", "):
        out = out.add(*c.split())
    out = out.add("_part", "long")
    kinds = to_arrow_schema(out)
    keys_ = by or ["_none"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        task, flushed = TaskContext.get().partitionId(), 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            cols = [t.column(keys_.index(c)).combine_chunks().dictionary_encode(null_encoding="encode") for c in keys_]
            code = np.zeros(len(t), np.int64)
            for c in cols:
                code = code * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
            vals = [t.column(len(keys_) + i).to_numpy() for i in range(len(values))]
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(order) else []
            for lo, hi in zip(edges, [*edges[1:], len(order)]):
                rows = order[lo:hi]
                key = tuple(c.dictionary[c.indices[int(rows[0])].as_py()].as_py() for c in cols)
                states[key] = how.add(states.get(key, how.zero), *[v[rows] for v in vals])
            if len(states) > held:
                yield _table(list(states), list(states.values()), [task * FLUSHES + flushed] * len(states), kinds)
                states, flushed = {}, flushed + 1
        yield _table(list(states), list(states.values()), [task * FLUSHES + flushed] * len(states), kinds)

    def merged(key, t):
        t = t.sort_by("_part")
        state = how.zero
        for row in zip(*(t[c].to_pylist() for c in how.names)):
            state = how.merge(state, row)
        part = t["_part"][0].as_py()
        return pa.Table.from_batches([_table([tuple(x.as_py() for x in key[: len(keys_)])], [state], [part // fan], kinds)])

    d = df if by else df.withColumn("_none", F.lit(0))
    ok = F.lit(True)
    for c in values:
        ok = ok & F.col(c).isNotNull()
    d = d.where(ok).select(*keys_, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)])
    level = stored(d.mapInArrow(partial, out), "states")
    while True:
        most = level.agg(F.max("_part")).first()[0]
        level = stored(level.groupBy(*keys_, F.floor(F.col("_part") / fan).alias("_group")).applyInArrow(merged, out), "states")  # `fan` states a group
        if not most or most < fan:
            break
    return level.select(*by, *how.names)


def updated_blocks(df: DataFrame, block: str, columns: Sequence[str], update: Callable[..., Sequence[np.ndarray]]) -> DataFrame:
    """df with its number columns changed by update(block, *arrays), called once for each block of rows; it returns as many arrays.
    A block is what one task holds, so its rows are bounded by how the caller numbers blocks."""
    schema = df.schema

    def one(key, t):
        new = update(key[0].as_py(), *[t[c].to_numpy() for c in columns])
        for c, v in zip(columns, new, strict=True):
            if len(v) != len(t):
                raise ValueError(f"{len(v)} values of {c} for {len(t)} rows")
            i = t.schema.get_field_index(c)
            t = t.set_column(i, t.schema.field(i), pa.array(v, t.schema.field(i).type))
        return t

    return df.groupBy(block).applyInArrow(one, schema)
