import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from timberline.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"vector_recall"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_coverage():
    assert set(QUERIES) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["level", "count", "percent"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    assert compare(spark, duck, FOLDER, name) is None
