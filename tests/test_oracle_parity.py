"""Every query with a SQL twin matches DuckDB on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from gale.sources.tables import TABLES
from tests.conftest import SMALL
from tools.oracle_check import _rows

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.sql(SQL[name])
    d_cols, d_rows = res.columns, res.fetchall()
    assert sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"grp", "event_pct"} <= set(df.columns)
