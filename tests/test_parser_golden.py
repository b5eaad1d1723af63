"""Extraction rules on golden Java inputs: a whole controller, and one file per rule."""
from __future__ import annotations

from collections import Counter

import pytest

from graphloom.operators.extract import parse
from graphloom.sources.files import files_from_binary

TIDES = """
package org.harbour.web;

import java.util.*;

/** Tide tables (not a class Foo { void bar() {} }). */
@Deprecated
@Controller
@RequestMapping("/tides")
final class TideTableController extends Base<Tide> implements Closeable {
    @Autowired GaugeStore gauges, spare;
    private static final int LIMIT = max(3, 4);

    @DeleteMapping(path = "/{port}/old")
    protected int purge(@PathVariable("port") String port) throws IOException {
        int n = gauges.dropBefore(port, LocalDate.now());
        log("purged(" + n + ")");
        return n;
    }

    @PutMapping
    synchronized List<Tide> replaceAll(List<Tide> rows) { return spare.store(rows); }

    long drift() { return Clock.offset() / 2; }
}
"""
TIDES_PATH = "/harbour/src/TideTableController.java"

GOLDEN = {
    "/g/Iface.java": "package a;\n@Service\npublic interface Foo { void m(); }\n",
    "/g/Color.java": "enum Color { RED; void m() {} }\n",
    "/g/Pt.java": "record P(int x) { void m() {} }\n",
    "/g/Empty.java": "",
    "/g/Two.java": (
        "class A { void a1() { x(); } }\n"
        "@Service\n"
        "class B { @GetMapping(\"/b\") void b1() {} }\n"
    ),
    "/g/Qual.java": (
        "@org.springframework.stereotype.Service\n"
        "class Q { @a.b.GetMapping(\"/q\") void q() {} }\n"
        "@Foo(@Service) class R {}\n"
    ),
    "/g/Deps.java": (
        "class D {\n"
        "  @Autowired(required=false) A a, b;\n"
        "  @Autowired private List<Foo> foos;\n"
        "  @Autowired Map<String, List<Bar>> m = null;\n"
        "  private C c;\n"
        "  @Autowired\n"
        "  public D(E e) { }\n"
        "  @Autowired void setF(F f) { }\n"
        "}\n"
    ),
    "/g/Ep.java": (
        "class Ep {\n"
        "  @GetMapping(\"/a\") void e1() {}\n"
        "  @PostMapping(value = \"/b\") void e2() {}\n"
        "  @PutMapping(path = \"/c\", consumes = \"x\") void e3() {}\n"
        "  @DeleteMapping void e4() {}\n"
        "  @GetMapping({\"/x\", \"/y\", \"/z\"}) void e5() {}\n"
        "  @RequestMapping(value = CONST, path = \"/d\") void e6() {}\n"
        "  @GetMapping(\"\") void e7() {}\n"
        "  @RequestMapping(headers = \"h=1\", value = \"/e\") void e8() {}\n"
        "  @PatchMapping(\"/p\") void e9() {}\n"
        "  @Deprecated @GetMapping(\"/f\") @PostMapping(\"/g\") void e10() {}\n"
        "  @GetMapping(value = \"/h\" + X) void e11() {}\n"
        "  @GetMapping(\"/i\" + X) void e12() {}\n"
        "  void e13(@RequestParam(\"id\") String id) {}\n"
        "}\n"
    ),
    "/g/Calls.java": (
        "class K {\n"
        "  void m() {\n"
        "    a().b().c();\n"
        "    list.forEach(x -> d(x));\n"
        "    new Thread(new Runnable() { public void run() { e(); } }).start();\n"
        "    Runnable r = this::f;\n"
        "    String s = \"g(\";  // h(\n"
        "    /* i( */\n"
        "    String t = \"\"\"\n"
        "        j(\n"
        "        \"\"\";\n"
        "    super.k();\n"
        "    this.<String>l();\n"
        "    new M();\n"
        "    class Local { Local() { n(); } }\n"
        "  }\n"
        "  K() { this(1); }\n"
        "  K(int x) { super(); }\n"
        "}\n"
    ),
    "/g/Edge.java": (
        "class Y {\n"
        "  List<X> Y() { return of(); }\n"
        "  <T> Y(T t) { init(); }\n"
        "  void m(int k) {\n"
        "    Thread.yield();\n"
        "    interface L { int f(int x); List<String> g(); int[] h(); }\n"
        "    Object o = new Outer<A>.Inner(1);\n"
        "    int r = switch (k) { case 1 -> one(k); default -> { yield (2); } };\n"
        "    boolean b = k > two(k);\n"
        "    if (b) three(); else four();\n"
        "  }\n"
        "}\n"
    ),
    "/g/Members.java": (
        "class Z {\n"
        "  Runnable r = new Runnable() { public void run() { } };\n"
        "  Runnable r2 = flag ? new Runnable() { public void run() {} } : null;\n"
        "  int[] arr = {1, 2, 3};\n"
        "  static { init(); }\n"
        "  { inst(); }\n"
        "  Z() {}\n"
        "  class Inner { void innerM() {} }\n"
        "  enum E { A, B; void em() {} }\n"
        "  interface I { void im(); }\n"
        "  record Rec(int a) { }\n"
        "  void real() {}\n"
        "  <T> T gen(T t) { return t; }\n"
        "  abstract int abs();\n"
        "  int[] arrRet() { return null; }\n"
        "  public <T> Z(T t) {}\n"
        "}\n"
    ),
    "/g/Over.java": (
        "class Over {\n"
        "  @GetMapping(\"/1\") void o(int a) { x(); }\n"
        "  void o(String s) { y(); }\n"
        "}\n"
    ),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(TIDES_PATH, TIDES)] + list(GOLDEN.items())
    df = spark.createDataFrame(rows, "path string, content string")
    return {r["path"]: r.asDict(recursive=True) for r in parse(df).collect()}


def _methods(rec):
    return [m["name"] for m in rec["methods"]]


def _by_name(rec):
    return {m["name"]: m for m in rec["methods"]}


# --- a whole controller ------------------------------------------------------
def test_controller_record(parsed):
    rec = parsed[TIDES_PATH]
    assert (rec["class_name"], rec["stereotype"], rec["autowired_deps"], rec["error"]) == ("TideTableController", "Controller", ["GaugeStore"], None)
    got = [(m["name"], m["http_method"], m["endpoint"], sorted(m["calls"])) for m in rec["methods"]]
    assert got == [
        ("purge", "DeleteMapping", "/{port}/old", ["dropBefore", "log", "now"]),
        ("replaceAll", "PutMapping", None, ["store"]),
        ("drift", None, None, ["offset"]),
    ]


def test_controller_sources_are_exact_slices(parsed):
    for m in parsed[TIDES_PATH]["methods"]:
        assert m["source_code"] in TIDES and m["source_code"].endswith("}")
    assert _by_name(parsed[TIDES_PATH])["drift"]["source_code"] == "long drift() { return Clock.offset() / 2; }"


# --- golden rules ------------------------------------------------------------
@pytest.mark.parametrize("path,stem", [("/g/Iface.java", "Iface"), ("/g/Color.java", "Color"), ("/g/Pt.java", "Pt"), ("/g/Empty.java", "Empty")])
def test_fallback_to_stem_without_methods(parsed, path, stem):
    rec = parsed[path]
    assert rec["class_name"] == stem
    assert rec["methods"] == []
    assert rec["stereotype"] is None
    assert rec["error"] is None


def test_two_top_level_classes(parsed):
    rec = parsed["/g/Two.java"]
    assert rec["class_name"] == "A"
    assert rec["stereotype"] == "Service"
    assert _methods(rec) == ["a1", "b1"]
    assert _by_name(rec)["b1"]["endpoint"] == "/b"


def test_qualified_annotations_do_not_match(parsed):
    rec = parsed["/g/Qual.java"]
    assert rec["stereotype"] is None
    assert _by_name(rec)["q"]["http_method"] is None


def test_autowired_field_types(parsed):
    assert parsed["/g/Deps.java"]["autowired_deps"] == ["A", "List<Foo>", "Map<String, List<Bar>>"]
    assert _methods(parsed["/g/Deps.java"]) == ["setF"]


def test_endpoints(parsed):
    ms = _by_name(parsed["/g/Ep.java"])
    got = {n: (m["http_method"], m["endpoint"]) for n, m in ms.items()}
    assert got == {
        "e1": ("GetMapping", "/a"),
        "e2": ("PostMapping", "/b"),
        "e3": ("PutMapping", "/c"),
        "e4": ("DeleteMapping", None),
        "e5": ("GetMapping", None),
        "e6": ("RequestMapping", "/d"),
        "e7": ("GetMapping", ""),
        "e8": ("RequestMapping", "/e"),
        "e9": (None, None),
        "e10": ("GetMapping", "/f"),
        "e11": ("GetMapping", None),
        "e12": ("GetMapping", None),
        "e13": (None, None),
    }


def test_calls(parsed):
    rec = parsed["/g/Calls.java"]
    assert _methods(rec) == ["m"]
    calls = Counter(rec["methods"][0]["calls"])
    assert calls == Counter(["a", "b", "c", "forEach", "d", "start", "e", "k", "l", "n"])


def test_calls_and_members_that_look_alike(parsed):
    rec = parsed["/g/Edge.java"]
    assert _methods(rec) == ["Y", "m"]
    assert _by_name(rec)["Y"]["calls"] == ["of"]
    assert sorted(_by_name(rec)["m"]["calls"]) == ["four", "one", "three", "two", "yield"]


def test_repeated_paths_keep_their_methods(spark):
    rows = [("/r/A.java", "class A { void one() { x(); } }"), ("/r/A.java", "class A { void two() { y(); } }"), ("/r/A.java", "class A { void two() { y(); } }")]
    got = parse(spark.createDataFrame(rows, "path string, content string")).collect()
    assert sorted(tuple(m["name"] for m in r["methods"]) for r in got) == [("one",), ("two",), ("two",)]


def test_members(parsed):
    assert _methods(parsed["/g/Members.java"]) == ["real", "gen", "abs", "arrRet"]
    src = _by_name(parsed["/g/Members.java"])["gen"]["source_code"]
    assert src == "<T> T gen(T t) { return t; }"


def test_overloads_kept_in_parse(parsed):
    rec = parsed["/g/Over.java"]
    assert _methods(rec) == ["o", "o"]
    assert [m["http_method"] for m in rec["methods"]] == ["GetMapping", None]


def test_bytes_decoding(spark):
    raw = b"class B {\r\n  void m() {\r    a();\xff\r\n  }\r\n}"
    df = files_from_binary(spark.createDataFrame([("file:/g/B.java", bytearray(raw))], "path string, content binary"))
    rec = parse(df).collect()[0].asDict(recursive=True)
    assert rec["path"] == "/g/B.java"
    assert rec["methods"][0]["source_code"] == "void m() {\n    a();�\n  }"
    assert rec["methods"][0]["calls"] == ["a"]


def test_large_comment_and_literal(spark):
    big = "/*" + "x" * 600_000 + "*/\n" + "// c\n" * 20_000
    lit = '"' + "y" * 300_000 + '"'
    src = big + "class Big { String s = " + lit + "; void m() { z(); } }\n"
    rec = parse(spark.createDataFrame([("/g/Big.java", src)], "path string, content string")).collect()[0]
    assert rec["class_name"] == "Big"
    assert [m["name"] for m in rec["methods"]] == ["m"]
    assert rec["methods"][0]["calls"] == ["z"]


def test_malformed_files_do_not_fail_the_job(spark):
    rows = [
        ("/m/Open.java", "class Open { void a() { b(); "),
        ("/m/Extra.java", "class Extra { void a() { } } } } void z() {}"),
        ("/m/Str.java", 'class Str { String s = "unterminated; void a() { c(); } }'),
        ("/m/Ok.java", "class Ok { void fine() { d(); } }"),
    ]
    got = {r["path"]: r for r in parse(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert len(got) == 4
    assert all(r["error"] is None for r in got.values())
    assert [m["name"] for m in got["/m/Ok.java"]["methods"]] == ["fine"]
    assert [m["name"] for m in got["/m/Extra.java"]["methods"]] == ["a"]


def test_scan_files_reads_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "Svc.java").write_bytes(b"@Service\r\nclass Svc { void run() { go(); } }\r\n")
    (tmp_path / "a" / "Readme.txt").write_text("not java")
    (tmp_path / "Top.java").write_text("class Top { }")
    from graphloom.sources.files import scan_files

    files = scan_files(spark, str(tmp_path))
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == {str(tmp_path / "a" / "b" / "Svc.java"), str(tmp_path / "Top.java")}
    assert rows[str(tmp_path / "Top.java")]["name"] == "Top.java"
    parsed = {r["path"]: r for r in parse(files.select("path", "content")).collect()}
    svc = parsed[str(tmp_path / "a" / "b" / "Svc.java")]
    assert svc["stereotype"] == "Service"
    assert svc["methods"][0]["calls"] == ["go"]
    with pytest.raises(Exception):
        scan_files(spark, str(tmp_path / "missing")).collect()
