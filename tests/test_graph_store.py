"""C9/S1 by touched buckets: equal to the upsert of whole graphs, and versions that hold the changed rows alone."""
from __future__ import annotations

import random

from graphloom.operators import extract as X
from graphloom.operators import graph as G
from graphloom.operators import store as S
from graphloom.streaming import ingest as ST
from test_graph_property import _random_corpus, _render

FILES = "path string, content string"


def _rows(graph):
    return {t: sorted(map(repr, map(tuple, df.collect()))) for t, df in graph.items()}


def _stored(spark, state, version):
    return {t: spark.read.schema(G.NODE_SCHEMAS[t]).parquet(f"{state}/{t}/version={version}").count() for t in G.GRAPH_TABLES}


def test_batches_equal_upserts_of_the_whole_graph(spark, tmp_path):
    rng, state, whole = random.Random(1), str(tmp_path / "state"), None
    for batch in range(2):
        # the same names and paths in every batch: files change, stubs get defined, nodes get new properties
        files = [(path, _render(cls, methods, deps)) for path, cls, methods, deps in _random_corpus(rng, "s", 9)]
        df = spark.createDataFrame(files, FILES)
        assert ST.upsert_batch(spark, state, df, batch, "s", buckets=4) == batch + 1
        whole = G.upsert_graph(spark, whole, X.parse(df), batch=batch + 1)
        whole = {t: rows.checkpoint() for t, rows in whole.items()}
        assert _rows(ST.current_graph(spark, state)[1]) == _rows(whole)


def test_a_version_holds_what_the_batch_changes(spark, tmp_path):
    state = str(tmp_path / "state")
    files = [(f"/w/F{i}.java", f"class F{i} {{ void m{i}() {{ log(1); }} void get() {{ }} }}") for i in range(60)]
    ST.upsert_batch(spark, state, spark.createDataFrame(files, FILES), 0, "s")
    assert _stored(spark, state, 1)["calls"] == 60
    # one file changes, one comes again as it is
    changed = spark.createDataFrame([files[9], ("/w/F7.java", "class F7 { void m7() { log(1); get(); } void get() { } }")], FILES)
    ST.upsert_batch(spark, state, changed, 1, "s")
    # m7 has new source text, and calls the get of every class
    assert _stored(spark, state, 2) == {"file_nodes": 0, "class_nodes": 0, "method_nodes": 1, "contains": 0, "defines": 0, "calls": 60, "depends_on": 0}


def test_buckets_are_pruned(spark, tmp_path):
    state = str(tmp_path / "state")
    rows = [(f"m{i}", "C", None, None, None) for i in range(200)]
    nodes = spark.createDataFrame(rows, G.NODE_SCHEMAS["method_nodes"])
    S.write_version({"method_nodes": nodes}, state, 1, 64)
    some = S.version_rows(spark, state, "method_nodes", 1, 1, [3, 5])
    want = {r["name"] for r in nodes.where(S.bucket_of("name", 64).isin(3, 5)).collect()}
    assert {r["name"] for r in some.collect()} == want and 0 < len(want) < 40
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_failed_attempt_is_replaced_and_a_published_batch_left(spark, tmp_path):
    state = str(tmp_path / "state")
    one = spark.createDataFrame([("/w/A.java", "class A { void a() { b(); } void b() { } }")], FILES)
    two = spark.createDataFrame([("/w/B.java", "class B { void c() { d(); } void d() { } }")], FILES)
    ST.upsert_batch(spark, state, one, 0, "s")
    # an attempt that wrote its version and never published it
    S.upsert(spark, state, X.parse(two), 2, 1, ST.BUCKETS)
    assert ST.current_graph(spark, state)[0] == 1 and ST.current_graph(spark, state)[1]["file_nodes"].count() == 1
    assert ST.upsert_batch(spark, state, two, 1, "s") == 2
    once = _rows(ST.current_graph(spark, state)[1])
    # the call of d came before d was there: run anew on its own result, it would bind B.d as well
    assert sum("'d'" in r for r in once["calls"]) == 1
    assert ST.upsert_batch(spark, state, two, 1, "s") == 2
    assert _rows(ST.current_graph(spark, state)[1]) == once


def test_a_new_base_is_the_same_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "LEAST_VERSIONS", 1)
    state = str(tmp_path / "state")
    for i, text in enumerate(("class A { void a() { b(); } }", "class B { void b() { c(); } void c() { a(); log(); } }")):
        ST.upsert_batch(spark, state, spark.createDataFrame([(f"/w/{i}.java", text)], FILES), i, "s", buckets=4)
    version, graph = ST.current_graph(spark, state)
    before = _rows(graph)
    assert [r["base"] for r in ST._published(spark, state)] == [1, 1, 3] and version == 3, "the second version outweighed the base"
    assert ST.rebase(spark, state, buckets=8) == 4
    assert _rows(ST.current_graph(spark, state)[1]) == before and len(before["file_nodes"]) == 2
    assert ST._published(spark, state)[-1]["buckets"] == 8
    assert not (tmp_path / "state" / "method_nodes" / "version=1").exists()
