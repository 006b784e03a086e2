"""Every registered query with a statement gives the statement's rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import connected, difference

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert difference(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1
