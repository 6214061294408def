"""Every registered query beside its SQL, and the driver contract."""

import pytest

import __spark_entry__
from sifthouse.queries import ORACLE_SQL, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_beside_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_driver_contract(spark):
    page = __spark_entry__.entry(spark).collect()
    assert len(page) > 1 and sorted(r["place"] for r in page if r["kind"] == "document") == list(range(1, 1 + sum(r["kind"] == "document" for r in page))) and all(0.15 <= r["relevance"] <= 1 for r in page)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
