"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry_point
from answerscope.plans import catalogue
from check import compare, open_tables

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return open_tables(folder)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, con, name):
    got = QUERIES[name](spark, folder).toArrow()
    assert compare(got, con.execute(ORACLES[name]).to_arrow_table()) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    assert got.columns and got.toArrow().num_rows >= 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1
