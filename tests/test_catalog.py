"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from oracle import compare, connect

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
EMPTY_AT_THIS_SIZE = {"calibration_offenders"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_agrees_with_its_sql(spark, con: duckdb.DuckDBPyConnection, name):
    problem = compare(spark, con, FOLDER, driver.queries()[name], driver.oracle_sql().get(name))
    if name in EMPTY_AT_THIS_SIZE and problem == "both empty":
        return
    assert problem is None


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
