"""Every registered query with SQL against DuckDB on the smallest data; rows-only queries have their own tests."""

import pytest

import __spark_entry__ as contract
from caudal.catalog import load
from tests.checking import compare, connect

SF = "/root/testdata/sf0.001"
# At this size few series are long enough for a spike, and no stored prediction is bad.
MAY_BE_EMPTY = {"check_spike", "prediction_problems"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in load().items() if q.sql is not None])
def test_query_matches_sql(spark, duck, name):
    verdict, *_ = compare(spark, duck, load()[name], SF)
    assert verdict == "ok" or (verdict == "ok EMPTY" and name in MAY_BE_EMPTY), verdict


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
