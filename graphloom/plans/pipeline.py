"""Shared plan pieces for the registered queries: corpus -> parsed -> graph.

Each piece is built once per (session, data folder) and written to the shared folder, so
that a session answering many queries lexes the corpus once.  What reads a piece has a plan
that starts at its files: plans that held the whole way from the tables once per reference
(and the plans that cached tables hold in turn) outgrew the driver.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import extract as X
from graphloom.operators import graph as G
from graphloom.session import scratch_path
from graphloom.sources import corpus as C

_MEMO: dict[tuple, object] = {}


def _key(spark: SparkSession, sf_dir: str, what: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what)


def memo(spark: SparkSession, sf_dir: str, what: str, build):
    k = _key(spark, sf_dir, what)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def known(spark: SparkSession, sf_dir: str, what: str):
    """A piece that was built before, or None."""
    return _MEMO.get(_key(spark, sf_dir, what))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"plan-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables(Mapping):
    """Tables of a graph by name, each written when it is first asked for."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._plans, self._done = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = _written(self._plans[name], name)
        return self._done[name]

    def __iter__(self):
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, sf_dir, "files", lambda: _written(C.corpus_files(spark, sf_dir), "files"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, sf_dir, "parsed", lambda: _written(X.parse(files(spark, sf_dir)), "parsed"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.flat_methods(parsed(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return memo(spark, sf_dir, "graph", lambda: Tables(G.build_graph(spark, parsed(spark, sf_dir), materialize=False)))


def settled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(
        spark,
        sf_dir,
        "calls_settled",
        lambda: _written(G.calls_settled(parsed(spark, sf_dir), graph(spark, sf_dir)["method_nodes"]), "calls-settled"),
    )


def clear() -> None:
    _MEMO.clear()
