"""Every registered query with a SQL counterpart, value by value at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from liftpanel.plans.catalog import QUERIES
from tests.conftest import SMALL
from tools.compare import TABLES, rows_of

# Queries of optional subpackages have tests of their own.
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_entry_is_the_known_slice(spark):
    """The flagship query at scale 0.01 gives the figures worked out by hand beforehand."""
    rows = entry.queries()["effect_summary"](spark, "/root/testdata/sf0.01").where("analysis_id = 'EUROPE' and run_kind = 'main'")
    got = {r.quantity: r for r in rows.collect()}
    assert got["actual"].average == pytest.approx(361235.6532, abs=0.01)
    assert got["predicted"].average == pytest.approx(306848.1377, abs=0.01)
    assert got["abs_effect"].cumulative == pytest.approx(5003651.42, abs=0.02)
    assert got["rel_effect"].cumulative == pytest.approx(0.177246, abs=1e-6)
    assert entry.entry(spark).count() == 100
