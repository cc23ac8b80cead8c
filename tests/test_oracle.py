"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from stepfold.plans.queries import REGISTRY
from tests.oracle_compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STATEMENTS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(STATEMENTS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, STATEMENTS[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20
