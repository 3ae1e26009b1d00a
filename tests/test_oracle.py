"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import duck, normal
from tests.conftest import SF

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert SQL.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    done = con.execute(SQL[name])
    expected = normal(done.fetchall(), [c[0] for c in done.description])
    assert normal([tuple(r) for r in df.collect()], df.columns) == expected
    assert expected[1]


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["period", "unique_file_paths"]
