"""Token rows: nesting counted per file without sorting or windows, also for text whose braces don't match."""
import io
from contextlib import redirect_stdout

from graphloom.operators import extract as X
from graphloom.operators import tokens as TK

FILES = [
    ("/a/A.java", "package a.b;\n@X.Y(value = f(1))\nclass A { int x = {1}; @Q(\"s\") void m(int i) { g(h(i), new b.C()); } }"),
    ("/a/Open.java", "class Open { void m( { f(1; } ) ) ( "),
    ("/a/Empty.java", ""),
    ("/a/Blank.java", " \n// nothing\n"),
    ("/a/Two.java", "record R(int a) {} class T { void n() { k(); } } ) ( class U { }"),
]


def expected(text: str, toks: list[tuple[int, str]]) -> list[tuple]:
    """(off, bd, pd, close_next) of each token by one plain pass."""
    rows, bd, pd, after = [], 0, 0, 0
    for i, (ws, tok) in enumerate(toks):
        rows.append([after + ws, bd, pd, None])
        after += ws + len(tok)
        bd += (tok == "{") - (tok == "}")
        pd += (tok == "(") - (tok == ")")
    level = [r[2] - (t == ")") for r, (_, t) in zip(rows, toks)]
    for i, (_, tok) in enumerate(toks):
        if tok == "(":
            later = [j for j in range(i + 1, len(toks)) if toks[j][1] in "()" and level[j] == level[i]]
            rows[i][3] = toks[later[0] + 1][1] if later and later[0] + 1 < len(toks) else None
    return [tuple(r) for r in rows]


def test_token_rows_are_those_of_a_plain_pass(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    keyed = TK.key_files(files, 1)  # all files in one Arrow batch
    got: dict[str, list] = {}
    for r in TK.token_table(keyed).join(keyed.select("fid", "fh", "path"), ["fid", "fh"]).orderBy("path", "pos").collect():
        got.setdefault(r["path"], []).append(r)
    assert set(got) == {"/a/A.java", "/a/Open.java", "/a/Two.java"}
    for path, rows in got.items():
        toks = [r["tok"] for r in rows]
        text = dict(FILES)[path]
        assert [(r["off"], r["bd"], r["pd"], r["close_next"]) for r in rows] == expected(text, [(r["ws_len"], r["tok"]) for r in rows])
        assert all(text[r["off"]:r["off"] + len(r["tok"])] == r["tok"] for r in rows)
        padded = [None] * 5 + toks + [None] * 2
        assert [[r[c] for c in ("p5", "p4", "p3", "p2", "p1", "n1", "n2")] for r in rows] == [
            padded[i:i + 5] + padded[i + 6:i + 8] for i in range(len(toks))]
    a = {(r["tok"], r["pos"]): r for r in got["/a/A.java"]}
    assert {t for (t, _), r in a.items() if r["ann"]} == {"X", "Y", "Q"}
    assert {(r["rkw"], r["rname"]) for r in got["/a/A.java"][-10:-1]} == {("class", "A")}
    assert sorted({(r["region"], r["rkw"], r["rname"]) for r in got["/a/Two.java"] if r["rkw"]}) == [(0, "record", "R"), (1, "class", "T"), (2, "class", "U")]


def test_parse_sorts_no_token_rows(spark):
    """Windows over all token rows, sorted twice, took most of the time of every query on the corpus."""
    out = io.StringIO()
    with redirect_stdout(out):
        X.parse(spark.createDataFrame(FILES, "path string, content string")).explain()
    plan = out.getvalue()
    assert "Window" not in plan
    assert "pos#" not in "".join(line for line in plan.splitlines() if " Sort " in line)


def test_rows_of_one_key_are_one_stream(spark):
    files = spark.createDataFrame([FILES[4], FILES[4], FILES[0]], "path string, content string")
    keyed = TK.key_files(files, 1)
    got = {r["path"]: (r["n_lparen"], r["n_lbrace"], r["max_depth"]) for r in TK.token_digest(TK.token_table(keyed), keyed).collect()}
    assert got == {"/a/Two.java": (8, 8, 4), "/a/A.java": (7, 3, 2)}
    twice = TK.token_table(keyed).where("tok = 'k'").select("pos", "p1", "n1").collect()
    assert sorted((r["p1"], r["n1"]) for r in twice) == [("k", "("), ("{", "k")]
    assert len({r["pos"] for r in twice}) == 1
