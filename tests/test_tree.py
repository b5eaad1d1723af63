"""A1, B10: listing and reading of real folders."""
import os

import pytest

from graphloom.operators import extract as X
from graphloom.operators import graph as G
from graphloom.sources import files as SRC
from graphloom.sources import tree


@pytest.fixture
def folder(tmp_path):
    def put(path, content=b"class A { void a() { b(); } }"):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(content)

    put("A.java")
    put("_B.java")
    put(".x/C.java", b"class C\r\n{}\xff")
    put("_y/D.java")
    put("E.java", b"")
    put("deep/er/and/deeper/F.java")
    put("x.java/G.java")
    put("H.JAVA")
    put("I.txt")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.java")
    os.symlink(tmp_path, tmp_path / "deep" / "loop")
    return tmp_path


WANTED = {"A.java", "_B.java", ".x/C.java", "_y/D.java", "E.java", "deep/er/and/deeper/F.java", "x.java/G.java"}


def test_whole_tree(spark, folder):
    got = {r.path[len(str(folder)) + 1 :]: r for r in SRC.scan_files(spark, str(folder)).collect()}
    assert set(got) == WANTED | {"gone.java"}
    assert {p for p, r in got.items() if r.error is None} == WANTED
    assert got[".x/C.java"].content == "class C\n{}�" and got[".x/C.java"].length == 12
    assert (got["E.java"].content, got["E.java"].length) == ("", 0)
    assert got["gone.java"].content is None and got["gone.java"].error == "No such file or directory"


def test_uri_and_names(spark, folder):
    got = SRC.scan_files(spark, f"file://{folder}", glob="*.JAVA", with_content=False).collect()
    assert [(r.name, r.error) for r in got] == [("H.JAVA", None)]
    got = tree.list_tree(spark, str(folder), "x.java", folders="error").collect()
    assert [(r.name, r.error) for r in got] == [("x.java", "Is a directory")]


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SRC.scan_files(spark, str(tmp_path / "none"))


def test_empty_root(spark, tmp_path):
    assert SRC.scan_files(spark, str(tmp_path)).count() == 0


def test_failures_are_rows(spark, folder):
    rows = [(f"{folder}/A.java", None), (f"{folder}/vanished.java", None), (f"{folder}/deep", None), (None, None), (f"{folder}/E.java", "kept back")]
    got = {r.path and os.path.basename(r.path): r for r in tree.read_tree(spark.createDataFrame(rows, "path string, error string")).collect()}
    assert got["A.java"].error is None and bytes(got["A.java"].content).startswith(b"class A")
    assert {k: r.error for k, r in got.items() if r.error} == {
        "vanished.java": "No such file or directory", "deep": "Is a directory", None: "no path", "E.java": "kept back"}
    assert tree.read_tree(spark.createDataFrame([], "path string")).count() == 0


def test_errors_reach_the_summary(spark, folder):
    parsed = X.parse(SRC.scan_files(spark, str(folder)))
    errors = [(os.path.basename(r.path), r.message) for r in G.parse_errors(parsed).collect()]
    assert errors == [("gone.java", "No such file or directory")]
    s = G.ingest_summary(parsed).first()
    assert (s.total_files, s.success_files, s.failed_files, s.n_errors) == (8, 7, 1, 1)


def test_large_folder_in_batches(spark, tmp_path):
    for i in range(12_000):
        (tmp_path / f"F{i}.java").touch()
    assert tree.list_tree(spark, str(tmp_path)).select("path").distinct().count() == 12_000


def test_write_and_read_back(spark, tmp_path):
    rows = [("/p/A.java", "one"), ("p/.b/B.java", ""), ("/p/A.java/C.java", "below a file"), ("/null.java", None), (None, "x")]
    done = {(r.path, r.bytes, r.error is None) for r in SRC.write_files(spark.createDataFrame(rows[:2] + rows[3:], "path string, content string"), str(tmp_path)).collect()}
    assert done == {("/p/A.java", 3, True), ("p/.b/B.java", 0, True), ("/null.java", None, False), (None, None, False)}
    below = SRC.write_files(spark.createDataFrame(rows[2:3], "path string, content string"), str(tmp_path)).first()
    assert below.error is not None
    assert {(r.name, r.content) for r in SRC.scan_files(spark, str(tmp_path)).collect()} == {("A.java", "one"), ("B.java", "")}
