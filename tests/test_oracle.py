"""Every catalog query against its DuckDB oracle on the driver's sf0.001
tables: same columns, same row count, same values (order-insensitive)."""

import duckdb
import pytest

import __spark_entry__ as E
from convolytics.plans.catalog import QUERIES
from session_rows import SF001

TABLES = ("conversations", "documents", "labels", "lineitem")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


def _norm(rows, cols):
    return sorted(tuple(repr(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    srows = [r.asDict() for r in df.collect()]
    sql = E.oracle_sql()[name]
    rel = con.sql(sql)
    ocols = rel.columns
    orows = [dict(zip(ocols, r)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    cols = sorted(ocols)
    assert _norm(srows, cols) == _norm(orows, cols)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "TOPIC"
    assert df.count() == 19
