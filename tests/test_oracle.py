"""Every query of the catalog against its SQL."""

import os

import oracle
import pytest

import __spark_entry__ as contract
from dataloupe.catalog import QUERIES, SQL

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def connections():
    return {sf: oracle.connect(f"{DATA}/sf{sf}") for sf in ("0.01",)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connections, name):
    table = QUERIES[name](spark, f"{DATA}/sf0.01")
    assert oracle.compare(table, connections["0.01"], SQL[name]) == []


def test_entry(spark):
    assert [r["act"] for r in contract.entry(spark).collect()] == [1, 2, 3]
