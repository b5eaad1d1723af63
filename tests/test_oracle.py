"""Every registered query against its DuckDB oracle on the smallest data set."""
from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_mod
from harness import compare, duck

SF_DIR = os.environ.get("GRAPHLOOM_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry_mod.queries()
ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["request_id", "route", "method", "class", "http_method", "source_code"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    own = {k for k in QUERIES if k != "pipeline" and not k.startswith("op")}
    assert own <= set(ORACLES)


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k != "pipeline" and not k.startswith("op")))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_DIR)
    ok, msg = compare(df, con, ORACLES[key])
    assert ok, msg
