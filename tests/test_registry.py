"""Every registered query against its check SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.registry.QUERIES, entry.registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = compare.spark_result(QUERIES[name](spark, SF_DIR))
    assert compare.difference(mine, compare.duck_result(duck, ORACLES[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
