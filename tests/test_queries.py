import pytest

import __spark_entry__ as entry_point
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    compare(entry_point.queries()[name](spark, SF_DIR), con, entry_point.oracle_sql()[name])
