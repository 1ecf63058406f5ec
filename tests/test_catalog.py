"""Every registered query with SQL gives what DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Solvers run many jobs; test_operators has them on smaller systems.
SLOW = {"gmres_solve", "minres_solve", "bicgstab_solve", "cr_solve", "hpc_cg_solve"}


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(want.columns, want.fetchall())


def test_every_query_names_its_inventory_lines():
    """All but these, which no line of the inventory asks for: fields of a JSON column, and text without control characters."""
    catalog.queries()
    assert {k for k, q in catalog.CATALOG.items() if not q.ids} == {"json_props", "printable_text"}


def test_queries_name_no_lines_that_are_not_built():
    catalog.queries()
    unbuilt = {"K03"}
    assert not {k: unbuilt & set(q.ids.split()) for k, q in catalog.CATALOG.items() if unbuilt & set(q.ids.split())}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
def test_whole_queries_leave_no_shard_or_vector_out(spark):
    sf = "/root/testdata/sf0.01"
    run = lambda name: catalog.queries()[name](spark, sf)
    stream = run("token_stream").collect()
    assert len(stream) > 3
    assert {r.shard: r["count"] for r in run("token_lead_targets").groupBy("shard").count().collect()} == {r.shard: r.n for r in stream}
    # a rank's half of each whole step of 2 ranks of 4 rows of 128 tokens
    assert {r.shard: r["count"] for r in run("batch_slices").groupBy("shard").count().collect()} == {r.shard: 512 * ((r.n - 1) // 1024) for r in stream if r.n > 1024}
    x = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    column = next(c for c in x.columns if hasattr(x[c].iloc[0], "__len__") and not isinstance(x[c].iloc[0], str))
    first = sum(float(v[0]) for v in x[column]) / x["vec_id"].floordiv(100).nunique()
    got = {r.i: r.g for r in run("gradient_accumulation").collect()}
    assert len(x) > 400 and abs(got[0] - first) < 1e-5
