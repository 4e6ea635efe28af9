"""Every operator query that has check SQL against it, on the smallest tables."""

import compare
import pytest

from shelfwise.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, sql in ORACLES.items() if sql))
def test_query_equals_its_sql(spark, name):
    mine = compare.spark_result(QUERIES[name](spark, SF_DIR))
    assert compare.difference(mine, compare.duck_result(compare.connect(SF_DIR), ORACLES[name])) is None
