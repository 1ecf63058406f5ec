"""Every registered query with the SQL that an independent engine runs for it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


CATALOG: dict[str, Query] = {}
#: Modules that register queries when imported.
MODULES = ("linear", "runs", "tensors", "training", "meshes", "hydro", "hydrostep", "readers", "state", "streams", "files", "elements", "figures")


def query(ids: str, sql: str | None = None):
    """Registers the decorated function; ids are the inventory lines it covers."""

    def add(f):
        CATALOG[f.__name__] = Query(f, sql, ids)
        return f

    return add


def _load() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return CATALOG


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in _load().items() if q.sql}
