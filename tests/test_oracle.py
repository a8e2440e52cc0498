"""Every registered query with SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry_module
from comparison import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, con, key):
    assert differences(QUERIES[key](spark, SF), con, ORACLE[key]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
