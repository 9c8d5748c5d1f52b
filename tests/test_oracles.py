"""Every query that SQL can express, row by row against DuckDB; the others run and give rows."""

import pytest

import __spark_entry__
from barloom.plans import catalog
from tests.compare import connect, duck_rows, spark_rows

SLOW = {"checklist_items", "verdict"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    sql = catalog.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == columns
    assert spark_rows(df, columns) == duck_rows(con, sql, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "percent_b" in df.columns


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_verdict_runs(spark, sf):
    """The whole chain: checklist over structure, patterns, waves and timeframes."""
    rows = catalog.queries()["verdict"](spark, sf).collect()
    assert rows and all(-1 <= r.score <= 1 and 0 <= r.coverage <= 1 and 0 <= r.conviction <= 1 for r in rows)
    assert all(r.bias in (-1, 0, 1) for r in rows)
