"""Shared plan pieces: written tables, so that what reads them has a short plan."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.plans import pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    supplier = spark.range(5).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).cast("int").alias("s_nationkey"), F.concat(F.lit("S"), "id").alias("s_name"))
    part = spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("red w"), F.col("id") % 7).alias("p_name"))
    supplier.write.parquet(f"{root}/supplier.parquet")
    part.write.parquet(f"{root}/part.parquet")
    yield root
    P.clear()


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_pieces_have_plans_that_begin_at_their_files(spark, folder):
    graph = P.graph(spark, folder)
    assert set(graph) == {"file_nodes", "class_nodes", "method_nodes", "contains", "defines", "calls", "depends_on"}
    for df in [P.files(spark, folder), P.parsed(spark, folder), P.settled_calls(spark, folder), *graph.values()]:
        assert len(_plan(df).splitlines()) <= 8
        assert df.count() > 0
    assert P.graph(spark, folder)["calls"] is graph["calls"]
