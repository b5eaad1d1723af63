"""Jaccard join, components, decontamination and SpotSigs against brute force."""
import hashlib
import random

import pytest
import regex

from graphloom.llm import decontaminate, jaccard_join, spotsigs
from graphloom.llm.components import components as connected
from helpers import SCHEMA, components, contamination, corpus, ordered


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 3), (20, 21), (5, 5)] + [(100, k) for k in range(101, 140)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys((1, 2, 3, 8, 9), 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 140), 100)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_jaccard_join(spark, size, num):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard_join.near_duplicates(docs, size, num, 100)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert ordered(got.collect()) == ordered(components(rows, size, num, 100))
    assert jaccard_join.near_duplicates(docs.limit(0), size, num, 100).count() == 0


def test_group_of_near_copies(spark):
    """Many copies with an edit each: all link through what they share, at the very threshold and beside it."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}x{i}" for i in range(120)]
    rows = []
    for k in range(80):
        words = list(base)
        for place in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            words[place] = f"edit{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(jaccard_join.near_duplicates(docs, 3, 90, 100).collect()) == ordered(components(rows, 3, 90, 100))


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard_join.keep_one(docs, 5, 80, 100)
    assert kept.schema == docs.schema
    found = kept.collect()
    brute = components(rows, 5, 80, 100)
    groups = {c for _, n, c in brute if n}
    assert sum(n == 0 for _, n, _ in brute) + len(groups) == len(found)
    assert groups <= {r.doc_id for r in found}


def test_keep_one_with_any_column_names(spark):
    names = ["_n", "_id", "_D0", "_d1", "_k0", "_k1_"]
    rows = corpus()
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs = spark.createDataFrame([(*r[:2], *range(6)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = jaccard_join.keep_one(docs, 5, 80, 100)
    assert kept.schema == docs.schema
    assert ordered(r[:2] for r in kept.collect()) == ordered(jaccard_join.keep_one(plain, 5, 80, 100).collect())


def test_decontamination(spark):
    rows = corpus()
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) == 80).split()
    items = [("b1", " ".join(long[5:30])), ("b2", "  ,, "), ("b3", None), (None, "changed"), ("b5", rows[9][1][:4000]), ("b1", " ".join(long[40:60])), ("b7", "zz")]
    rows += [(900, " ".join(x.upper() for x in long[5:18]), None, None, 0, None, None, None), (901, "a. " + "; ".join(long[6:30]), None, None, 0, None, None, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    for kw in ({}, {"shard_bytes": 500, "block_bytes": 100}):
        got = decontaminate.scan(docs, bench, **kw).drop("spans").collect()
        assert ordered(got) == ordered((r[0], *contamination(r[1], items)) for r in rows)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.schema == docs.schema
    assert ordered(r[:2] for r in kept.collect()) == ordered(r[:2] for r in rows if not contamination(r[1], items)[4])
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches(spark):
    words = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[3:33]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")
    (span,) = decontaminate.scan(docs, bench).first().spans
    assert tuple(span) == ("i", 2, 3, 30)


def spots(text: str) -> set:
    words = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    content = [x for x in words if x not in spotsigs.ANCHORS]
    if len(content) < 2:
        return {("^", " ".join(words))} if words else set()
    out, k = {("^", *content[:2])}, 0
    for x in words:
        if x in spotsigs.ANCHORS:
            if k + 1 < len(content):
                out.add((x, content[k], content[k + 1]))
        else:
            k += 1
    return out


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_neighbours(spark):
    rng = random.Random(4)
    words = ["the", "of", "is", "le", *(f"w{i}" for i in range(30)), "Éa", "😀x"]
    rows = [(i * 7, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(1500)] + [(-5, None), (3, "")]
    got = {r.doc_id: r for r in spotsigs.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for at, (key, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(spots(text), spots(edited)))
        assert r.near_next == pytest.approx(jaccard(spots(text), spots(after)))
        assert len([x for x in r.fingerprint.split(",") if x]) == len(spots(text))


@pytest.mark.parametrize("ids", ["outlier", "clusters", "nulls", "one"])
def test_spotsigs_buckets(spark, ids):
    """Skewed ids: buckets of like size, and each row meets the next one of the whole order."""
    key = {"outlier": lambda i: i if i else 1 << 62, "clusters": lambda i: (i % 3) * (1 << 61) - (1 << 62) + i // 3, "nulls": lambda i: i if i % 3 else None, "one": lambda i: 7}[ids]
    rows = [(key(i), f"w{i} the x{i % 7} y{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in spotsigs.with_next(docs, "doc_id", "text").where("guest = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = sorted(r.edited_sha256 for r in spotsigs.compare_neighbours(docs).collect())
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(false, text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    edited = [t[: len(t) - len(t) // 3] + order[(i + 1) % len(order)][1][: len(t) // 3] for i, (_, t) in enumerate(order)]
    assert got == sorted(hashlib.sha256(t.encode()).hexdigest() for t in edited)


def test_spotsigs_awkward_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = spotsigs.compare_neighbours(docs).collect()
    assert len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.doc_id == 12}) == 1
    assert spotsigs.compare_neighbours(docs.limit(0)).count() == 0
    one = spotsigs.compare_neighbours(docs.where("doc_id = 20")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_spotsigs_pairs(spark):
    rng = random.Random(6)
    words = ["the", "of", "is", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(40)]
    rows += [(100 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(20)] + [(200, rows[0][1])]
    members, pairs = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    of = {r.id: r.cid for r in members.collect()}
    assert of[200] == 0
    got = {tuple(sorted((r.a, r.b))) for r in pairs.collect()}
    sets = {i: spots(t) for i, t in rows if of[i] == i}
    assert got == {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8 - 1e-12}
