"""The sliding z-score as a stateful stream: the same values as the batch form gives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = 128


def push(held: list[float], seen: int, value: float, window: int = WINDOW) -> tuple[float | None, int]:
    """The value's score, and how many came so far; held is the ring of the last `window` values."""
    if len(held) < window:
        held.append(value)
    else:
        held[seen % window] = value
    seen += 1
    if seen <= window:
        return None, seen
    mean = math.fsum(held) / len(held)
    dev = math.sqrt(math.fsum((x - mean) ** 2 for x in held) / len(held))
    return (0.0 if dev == 0 else (value - mean) / dev), seen


def scores(stream: DataFrame, series: str, order: str, value: str, window: int = WINDOW) -> DataFrame:
    """(series, order, z) of a stream whose micro-batches come in order; state is one ring a series."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(parts)).sort_values(order)
        z = []
        for v in rows[value]:
            score, seen = push(held, seen, float(v), window)
            z.append(score)
        state.update((held, seen))
        yield pd.DataFrame({series: key[0], order: rows[order].to_numpy(), "z": pd.array(z, "Float64").to_numpy(float, na_value=math.nan)})

    kinds = dict(stream.dtypes)
    out = f"{series} {kinds[series]}, {order} {kinds[order]}, z double"
    return stream.select(series, order, value).groupBy(series).applyInPandasWithState(step, out, "held array<double>, seen long", "append", GroupStateTimeout.NoTimeout)
