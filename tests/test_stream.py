"""Incremental ingest: replays, new checkpoints, repeated paths, and stale nodes after a rename."""
from __future__ import annotations

from graphloom.operators import extract as X
from graphloom.operators import graph as G
from graphloom.streaming import ingest as ST


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_new_checkpoint_goes_on_from_the_published_graph(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    _files(spark, [("/s/A.java", "class A { void a() { b(); } }")]).write.parquet(src)
    assert ST.stream_ingest(spark, src, state, str(tmp_path / "c1")) == 1
    _files(spark, [("/s/B.java", "class B { void b() { } }")]).write.mode("append").parquet(src)
    assert ST.stream_ingest(spark, src, state, str(tmp_path / "c1")) == 2
    src2 = str(tmp_path / "src2")
    _files(spark, [("/s/C.java", "class C { void c() { } }")]).write.parquet(src2)
    assert ST.stream_ingest(spark, src2, state, str(tmp_path / "c2")) == 3
    version, graph = ST.current_graph(spark, state)
    assert version == 3
    assert {r["path"] for r in graph["file_nodes"].collect()} == {"/s/A.java", "/s/B.java", "/s/C.java"}
    assert not (tmp_path / "state" / "v1").exists()


def test_replayed_batch_rewrites_its_own_version(spark, tmp_path):
    state = str(tmp_path / "state")
    one = _files(spark, [("/s/A.java", "class A { void a() { } }")])
    two = _files(spark, [("/s/B.java", "class B { void b() { } }")])
    assert ST.upsert_batch(spark, state, one, 0, "s") == 1
    assert ST.upsert_batch(spark, state, two, 1, "s") == 2
    assert ST.upsert_batch(spark, state, two, 1, "s") == 2
    version, graph = ST.current_graph(spark, state)
    assert version == 2 and graph["file_nodes"].count() == 2


def test_last_version_of_a_path_counts(spark):
    rows = [("/s/A.java", "class A { void old() { } }", 1), ("/s/A.java", "class A { void fresh() { } }", 2)]
    df = spark.createDataFrame(rows, "path string, content string, at int")
    assert [r["content"] for r in ST.latest_per_path(df).collect()] == ["class A { void fresh() { } }"]


def test_stale_nodes_after_a_class_rename(spark):
    before = X.parse(_files(spark, [("/s/A.java", "class A { void a() { } void keep() { } }"), ("/s/B.java", "class B { void b() { } }")]))
    graph = G.build_graph(spark, before)
    fresh = X.parse(_files(spark, [("/s/A.java", "class Z { void keep() { } }")]))
    got = {tuple(r) for r in G.stale_nodes(graph, fresh).collect()}
    assert got == {("method", "a", "A"), ("method", "keep", "A"), ("class", "A", None)}
