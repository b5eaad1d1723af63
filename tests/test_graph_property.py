"""C6/C8/C9 closed form against a sequential simulation of keyed upserts.

The simulation replays the ingest the way one-statement-at-a-time MERGEs would:
files in path order, a Class node per file, then per method its node, its
DEFINES edge and per call a bind-all-by-name-or-create-stub; then per dependency
the same binding on Class nodes.
"""
from __future__ import annotations

import random

import pytest

from graphloom.operators import extract as X
from graphloom.operators import graph as G


def _random_corpus(rng: random.Random, tag: str, n_files: int):
    names = [f"{tag}m{i}" for i in range(6)]
    classes = [f"{tag}C{i}" for i in range(4)]
    files = []
    for f in range(n_files):
        cls = rng.choice(classes)
        methods = []
        for _ in range(rng.randint(0, 4)):
            methods.append((rng.choice(names), [rng.choice(names + [f"{tag}ext"]) for _ in range(rng.randint(0, 3))]))
        deps = [rng.choice(classes + [f"{tag}X"]) for _ in range(rng.randint(0, 2))]
        files.append((f"/{tag}/f{f:02d}.java", cls, methods, deps))
    return files


def _render(cls, methods, deps):
    out = [f"class {cls} {{"]
    for i, d in enumerate(deps):
        out.append(f"  @Autowired {d} d{i};")
    for name, calls in methods:
        body = " ".join(f"{c}(1);" for c in calls)
        out.append(f"  void {name}() {{ {body} }}")
    out.append("}")
    return "\n".join(out)


def _simulate(files):
    mnodes, cnodes = set(), set()
    calls, deps_e = set(), set()
    for path, cls, methods, deps in sorted(files):
        cnodes.add((cls, path))
        for name, cl in methods:
            mnodes.add((name, cls))
            for c in cl:
                bound = [n for n in mnodes if n[0] == c]
                if not bound:
                    mnodes.add((c, None))
                    bound = [(c, None)]
                for b in bound:
                    calls.add((name, cls, b[0], b[1]))
        for d in deps:
            bound = [n for n in cnodes if n[0] == d]
            if not bound:
                cnodes.add((d, None))
                bound = [(d, None)]
            for b in bound:
                deps_e.add((cls, path, b[0], b[1]))
    return mnodes, cnodes, calls, deps_e


@pytest.fixture(scope="module")
def corpora():
    rng = random.Random(7)
    return [_random_corpus(rng, f"t{i}", rng.randint(1, 6)) for i in range(25)]


def _rows(files):
    return [(p, _render(c, m, d)) for p, c, m, d in files]


def test_first_run_matches_simulation(spark, corpora):
    rows = [r for files in corpora for r in _rows(files)]
    parsed = X.parse(spark.createDataFrame(rows, "path string, content string"))
    g = G.build_graph(spark, parsed)
    got_m = {(r[0], r[1]) for r in g["method_nodes"].select("name", "class_name").collect()}
    got_c = {(r[0], r[1]) for r in g["class_nodes"].select("name", "file_path").collect()}
    got_calls = {tuple(r) for r in g["calls"].collect()}
    got_deps = {tuple(r) for r in g["depends_on"].collect()}
    exp_m, exp_c, exp_calls, exp_deps = set(), set(), set(), set()
    for files in corpora:
        m, c, cl, d = _simulate(files)
        exp_m |= m
        exp_c |= c
        exp_calls |= cl
        exp_deps |= d
    assert got_m == exp_m
    assert got_c == exp_c
    assert got_calls == exp_calls
    assert got_deps == exp_deps


def test_upsert_of_later_files_equals_one_run(spark, corpora):
    rows = [r for files in corpora for r in _rows(files)]
    df = spark.createDataFrame(rows, "path string, content string")
    split = "/t2"
    first = G.build_graph(spark, X.parse(df.filter(df.path < split)))
    both = G.upsert_graph(spark, first, X.parse(df.filter(df.path >= split)), batch=2)
    whole = G.build_graph(spark, X.parse(df))
    for t in ("method_nodes", "class_nodes", "calls", "depends_on", "defines", "contains", "file_nodes"):
        a = sorted(map(tuple, both[t].collect()), key=repr)
        b = sorted(map(tuple, whole[t].collect()), key=repr)
        assert a == b, t


def test_upsert_never_deletes(spark):
    v1 = spark.createDataFrame([("/u/A.java", "class A { void a() { b(); } void b() {} }")], "path string, content string")
    v2 = spark.createDataFrame([("/u/A.java", "class A { void c() {} }")], "path string, content string")
    g1 = G.build_graph(spark, X.parse(v1))
    g2 = G.upsert_graph(spark, g1, X.parse(v2), batch=2)
    names = {r[0] for r in g2["method_nodes"].collect()}
    assert names == {"a", "b", "c"}
    assert g2["calls"].count() == 1
    stale = {tuple(r) for r in G.stale_nodes(g2, X.parse(v2)).collect()}
    assert stale == {("method", "a", "A"), ("method", "b", "A")}
