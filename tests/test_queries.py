"""Every query with an SQL form against DuckDB on the smallest tables; the others must run and give rows."""

import math
import os

import duckdb
import pytest

from cairn.plans import domain, relational, storage

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = relational.QUERIES | domain.QUERIES | storage.QUERIES, relational.SQL | domain.SQL | storage.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert same([tuple(r) for r in got.collect()], got.columns) == same(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    t = QUERIES[name](spark, DIR)
    rows = t.collect()
    assert rows and len(set(t.columns)) == len(t.columns)
    assert not any(isinstance(v, float) and not math.isfinite(v) for r in rows for v in r)


def test_scans_are_pruned_and_pushed_down(spark):
    plan = QUERIES["s03_pruned_scan"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_quantity,2.0)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["j04_radius_join", "j05_interpolate", "j06_nearest", "a04_model_metrics", "a18_component_bootstrap"])
def test_no_nested_loops_over_tables(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name.startswith("j"):
        assert "BroadcastNestedLoopJoin" not in plan
