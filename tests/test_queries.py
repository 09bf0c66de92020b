"""Every query that has SQL gives the rows of DuckDB; the others run."""

import oracle
import pytest
from conftest import SF

import __spark_entry__
from isoreach.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert oracle.differences(df, duck, ORACLES[name]) == ""
    assert not oracle.type_differences(df, duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 150
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
