"""Write policy, path normalisation, key terms and BM25 against plain-Python rules."""
from __future__ import annotations

import math
import posixpath
import regex

import pytest
from pyspark.sql import functions as F

from graphloom.functions import lexicon as L
from graphloom.functions import text as TX
from graphloom.operators import policy as PO
from graphloom.operators import search as S

PATHS = ["/a/b/../c", "/a/./b//c/", "/../x", "a/b", "/repo-evil/x.java", "/repo/.git/HEAD", "/repo/k.PEM",
         "/repo/.env", "/repo/.ENV", "/repo/A.java", "/repo/.java", "/"]


def test_normalize_path(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = [r[0] for r in df.select(PO.resolve(F.col("p"))).collect()]
    exp = [posixpath.normpath(p if p.startswith("/") else "/" + p) for p in PATHS]
    assert got == exp


def test_policy_rules(spark):
    writes = spark.createDataFrame([(i, p, "xé") for i, p in enumerate(PATHS)], "seq bigint, file_path string, content string")
    loose = {r["file_path"]: r for r in PO.classify_writes(writes, PO.parse_roots(" /repo ; ")).collect()}
    assert loose["/repo-evil/x.java"]["status"] == "success"  # raw prefix test
    assert loose["/repo/.git/HEAD"]["reason"] == "Writing inside .git is blocked."
    assert loose["/repo/k.PEM"]["reason"] == "Writing to k.PEM is blocked."
    assert loose["/repo/.env"]["reason"] == "Writing to .env is blocked."
    assert loose["/repo/.ENV"]["status"] == "success"
    assert loose["/repo/A.java"]["bytes_written"] == 3
    assert loose["/repo/A.java"]["warning"] == "Graph is stale for A.java — re-run ingestion to sync."
    assert loose["/repo/.java"]["warning"] is None
    assert loose["/a/b/../c"]["reason"] == "Path /a/c is outside allowed roots."
    strict = {r["file_path"]: r for r in PO.classify_writes(writes, ["/repo"], strict=True).collect()}
    assert strict["/repo-evil/x.java"]["status"] == "error"
    anywhere = PO.classify_writes(writes, []).filter("status = 'error'").count()
    assert anywhere == 3  # .git, .PEM and .env; no roots means every place is allowed


def test_invalid_paths_fail_closed(spark):
    writes = spark.createDataFrame([(1, None, "x"), (2, "/repo/a\0.java", "x"), (3, "/repo/b.java", "x")], "seq bigint, file_path string, content string")
    got = {r["seq"]: (r["status"], r["reason"]) for r in PO.classify_writes(writes, ["/repo"]).collect()}
    assert got == {1: ("error", L.MSG_INVALID_PATH), 2: ("error", L.MSG_INVALID_PATH), 3: ("success", None)}


def test_apply_writes_last_wins(spark):
    files = spark.createDataFrame([("/r/a", "old"), ("/r/b", "keep")], "path string, content string")
    writes = spark.createDataFrame([(1, "/r/a", "v1"), (3, "/r/./a", "v3"), (2, "/r/a", "v2"), (4, "/r/c", "new")],
                                   "seq bigint, file_path string, content string")
    out = dict(PO.apply_writes(files, PO.classify_writes(writes)).collect())
    assert out == {"/r/a": "v3", "/r/b": "keep", "/r/c": "new"}


def _py_key_terms(q):
    words = q.lower().replace("?", "").replace(",", "").split()
    return list(dict.fromkeys(w for w in words if w not in set(L.STOP_WORDS) and len(w) > 2))[:3]


@pytest.mark.parametrize("q", ["How does the harbour pilot board a ship?", "What is the, the, foo.bar of x?",
                               "  tell me   about PatientService.register  and register ", "a an the", ""])
def test_key_terms(spark, q):
    got = spark.createDataFrame([(q,)], "q string").select(TX.key_terms(F.col("q"))).first()[0]
    assert got == _py_key_terms(q)


def test_bm25_scores(spark):
    docs = [(1, "alpha beta beta gamma"), (2, "beta delta"), (3, "svc.register register"), (4, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    idx = S.build_index(df, ["doc_id"], {"text": F.col("text")})
    q = spark.createDataFrame([(1, ["beta"]), (2, ["register"]), (3, ["Beta", "gamma"])], "query_id bigint, terms array<string>")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in S.search(idx, q).collect()}

    toks = {d: regex.findall(L.ANALYZER_STANDARD, t.lower()) for d, t in docs}
    toks = {d: t for d, t in toks.items() if t}
    n = len(toks)
    avg = sum(map(len, toks.values())) / n

    def score(d, terms):
        s = 0.0
        for t in terms:
            tf = toks[d].count(t)
            if not tf:
                continue
            dfreq = sum(1 for v in toks.values() if t in v)
            idf = math.log(1 + (n - dfreq + 0.5) / (dfreq + 0.5))
            s += idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(toks[d]) / avg))
        return round(s, 6)

    assert toks[3] == ["svc.register", "register"]
    exp = {(1, 1): score(1, ["beta"]), (1, 2): score(2, ["beta"]), (2, 3): score(3, ["register"]),
           (3, 1): score(1, ["beta", "gamma"]), (3, 2): score(2, ["beta", "gamma"])}
    assert got == pytest.approx(exp)
