"""Queries that SQL can express against DuckDB."""
import pytest

from graphloom.llm import queries
from harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, key):
    ok, message = compare(queries.REGISTRY[key](spark, SF), duck(SF), queries.ORACLES[key])
    assert ok, message
