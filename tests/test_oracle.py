"""Every registered query with SQL matches DuckDB on sf0.001 (value hash
after sorting columns by name, doubles compared at 6 decimals)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQLS = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        # 6 decimals, and 12 significant digits for large magnitudes
        return None if math.isnan(v) else float(f"{round(v, 6):.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(rows, df.columns) == _canon(res.fetchall(), dcols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "lcr_ratio" in df.columns
