"""Stale edges by support counts, against a graph walk in plain Python."""
from __future__ import annotations

import random

import pytest

from graphloom.operators import extract as X
from graphloom.operators import graph as G
from graphloom.operators import provenance as PR


def source(name, deps, methods):
    fields = "".join(f"    @Autowired\n    private {d} f{i};\n" for i, d in enumerate(deps))
    body = "".join(f"    void {m}() {{ {' '.join(c + '();' for c in calls)} }}\n" for m, calls in methods)
    return f"class {name} {{\n{fields}{body}}}\n"


def files_of(rng, n):
    return {f"/p/F{i}.java": (f"C{i % 5}", [f"C{rng.randrange(7)}" for _ in range(rng.randrange(3))],
                              [(f"m{k}", [f"m{rng.randrange(8)}" for _ in range(rng.randrange(4))]) for k in rng.sample(range(7), 3)]) for i in range(n)}


def refs_of(files):
    out = set()
    for path, (name, deps, methods) in files.items():
        out |= {("calls", m, name, c) for m, calls in methods for c in calls}
        out |= {("depends_on", name, path, d) for d in deps}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stale_edges(spark, seed):
    rng = random.Random(seed)
    before = files_of(rng, 8)
    changed = {p: v for p, v in files_of(rng, 8).items() if p in ("/p/F1.java", "/p/F4.java")}
    removed = ["/p/F2.java", "/p/F6.java", "/p/never.java"]
    after = {p: v for p, v in {**before, **changed}.items() if p not in removed}

    def parsed(files):
        return X.parse(spark.createDataFrame([(p, source(*v)) for p, v in files.items()], "path string, content string")).checkpoint()

    old, fresh = parsed(before), parsed(changed)
    graph = {k: v.checkpoint() for k, v in G.build_graph(spark, old).items()}
    gone = spark.createDataFrame([(p,) for p in removed], "path string")
    refs = PR.references(old).checkpoint()
    got = PR.stale_edges(graph, refs, fresh, gone).checkpoint()

    live_refs, touched = refs_of(after), {*changed, *removed}
    live_methods = {(m, name) for name, _, methods in after.values() for m, _ in methods}
    live_classes = {(name, p) for p, (name, _, _) in after.items()}
    want = set()
    for r in graph["calls"].collect():
        if ("calls", r.src_name, r.src_class, r.dst_name) not in live_refs or (r.dst_class is not None and (r.dst_name, r.dst_class) not in live_methods):
            want.add(("calls", r.src_name, r.src_class, r.dst_name, r.dst_class))
    for r in graph["depends_on"].collect():
        if ("depends_on", r.src_name, r.src_file_path, r.dst_name) not in live_refs or (r.dst_file_path is not None and (r.dst_name, r.dst_file_path) not in live_classes):
            want.add(("depends_on", r.src_name, r.src_file_path, r.dst_name, r.dst_file_path))
    for r in graph["contains"].collect():
        if r.file_path in touched and (r.class_name, r.file_path) not in live_classes:
            want.add(("contains", r.file_path, None, r.class_name, r.file_path))
    for r in graph["defines"].collect():
        if r.file_path in touched and not (r.file_path in after and any(m == r.method_name for m, _ in after[r.file_path][2]) and after[r.file_path][0] == r.class_name):
            want.add(("defines", r.class_name, r.file_path, r.method_name, r.class_name))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    kept = PR.prune_edges(graph, got)
    assert sum(kept[k].count() for k in ("calls", "depends_on", "contains", "defines")) == sum(graph[k].count() for k in ("calls", "depends_on", "contains", "defines")) - len(want)
    now = {tuple(r) for r in PR.updated_references(refs, fresh, gone).select(*PR.REFERENCE).collect()}
    assert now == live_refs


def test_nothing_changed(spark):
    parsed = X.parse(spark.createDataFrame([("/p/A.java", source("A", ["B"], [("a", ["b", "a"])]))], "path string, content string")).checkpoint()
    graph, refs = G.build_graph(spark, parsed), PR.references(parsed)
    assert PR.stale_edges(graph, refs, parsed).count() == 0
    assert PR.stale_edges(graph, refs, parsed.limit(0)).count() == 0
