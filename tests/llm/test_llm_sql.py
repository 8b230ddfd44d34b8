"""Queries of the subpackage that SQL can state, on the smallest driver tables."""

import os

import oracle
import pytest
from pactlens.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note
