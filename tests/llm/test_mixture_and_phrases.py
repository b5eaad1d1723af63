"""Source mixing and phrase mining against plain versions."""
import collections
import hashlib
import math
import random
import re

import pytest

from graphloom.llm import collocations, mixture
from helpers import LOWER, SCHEMA, SPACED, corpus, ordered

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def mixed(rows, weight):
    """(id, size, source_size, target, taken) by one sort of each source."""
    size = [len(SPACED.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(z for z, r in zip(size, rows) if r[3] == s) for s in sources}
    share, target, open_ = 1.5 * sum(size), {}, list(sources)
    own = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    while open_:
        per = (share - sum(2 * words[s] for s in sources if s not in open_)) / sum(own[s] for s in open_)
        above = [s for s in open_ if per * own[s] > 2 * words[s] + 1e-9]
        for s in open_:
            target[s] = 2 * words[s] if s in above else per * own[s]
        if not above:
            break
        open_ = [s for s in open_ if s not in above]

    def key(r):
        digest = hashlib.md5(("mix\x1f" + ("" if r[0] is None else str(r[0])) + "\x1f" + (r[1] or "")).encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 0.5) / 2**52) / weight.get(r[0], 1.0)

    out = []
    for s in sources:
        take = min(round(target[s]), 2 * words[s])
        epochs = take // words[s] if words[s] else 0
        left = take - epochs * words[s]
        for _, _, z, i in sorted((key(r), -1 if r[0] is None else r[0], z, i) for i, (r, z) in enumerate(zip(rows, size)) if r[3] == s):
            part = min(left, z)
            left -= part
            out.append((rows[i][0], z, words[s], round(target[s], 6), epochs * z + part))
    return out


def flat(frame):
    return ordered((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in frame.collect())


@pytest.mark.parametrize("case", ["plain", "copies", "one source"])
def test_mix(spark, case):
    rows = corpus()
    if case == "copies":
        rows += [rows[20]] * 300 + [(2000 + i, rows[21][1], "en", "src3", 1, 1.0, 1, 1) for i in range(200)]
    if case == "one source":
        rows = [(*r[:3], None, *r[4:]) for r in rows]
    weight = {i: 0.5 + i % 3 for i in range(0, 60, 2)}
    quality = spark.createDataFrame([*weight.items(), (1, None), (3, float("nan")), (None, 9.0)], "doc_id long, quality double")
    got = flat(mixture.mix(spark.createDataFrame(rows, SCHEMA), quality))
    assert got == ordered(mixed(rows, weight))
    assert got == flat(mixture.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), quality))


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNK", 16)
    rows = corpus() + [corpus()[20]] * 300
    assert flat(mixture.mix(spark.createDataFrame(rows, SCHEMA))) == ordered(mixed(rows, {}))


def test_quality_comes_first(spark):
    rows = [(i, "a b c d", None, "stu"[i % 3], 0, 0.0, 0, 0) for i in range(2000)]
    quality = spark.createDataFrame([(i, 8.0 if i % 7 < 2 else 1.0) for i in range(2000)], "doc_id long, w double")
    got = mixture.mix(spark.createDataFrame(rows, SCHEMA), quality).where("source = 'u'").collect()
    good = [r.taken for r in got if r.doc_id % 7 < 2]
    assert sum(good) / len(good) > 1.15 * sum(r.taken for r in got) / len(got)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert mixture.mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None, "a", 0, 0.0, 0, 0), (2, "", None, None, 0, 0.0, 0, 0)], SCHEMA)
    assert flat(mixture.mix(empty)) == ordered([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def phrases(rows, least, top, depth=5):
    f = collections.defaultdict(collections.Counter)
    for r in rows:
        for piece in PIECE.split((r[1] or "").translate(LOWER)):
            w = WORD.findall(piece)
            for k in range(1, depth + 1):
                f[r[2] or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        often = {p: c for p, c in count.items() if c >= least}
        longer = collections.Counter()
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], c)
        found = []
        for p, a in often.items():
            if len(p) >= 2 and longer[p] < a:
                score, _, l, r = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return out


def text_rows(hot):
    rng = random.Random(4)
    common = ["The", "of", "und", "é", "x"] + [f"w{i}" for i in range(30)]
    rows = corpus(seed=6)
    for i in range(150):
        body = "".join(rng.choice(common[: 5 if hot and i % 2 else 35]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]) for _ in range(rng.choice([3, 60, 200])))
        rows.append((500 + i, body + (" alpha beta Gamma delta epsilon zeta" if hot else ""), rng.choice(["en", "de", None]), None, 0, 0.0, 0, 0))
    return rows


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("least", [3, 20])
def test_phrases(spark, monkeypatch, hot, least):
    monkeypatch.setattr(collocations, "ROUTE_SUFFIXES", 256)
    rows = text_rows(hot)
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA), least=least, top=200)
    assert ordered(got.collect()) == ordered(phrases(rows, least, 200))


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.where("text is null")).count() == 0


def test_quicksort_counts_prefixes():
    import numpy as np

    rng = np.random.default_rng(2)
    keys = rng.integers(0, 4, (500, 4)).astype(np.int32)
    ends = rng.integers(1, 5, 500)
    keys[np.arange(4) >= ends[:, None]] = -1
    weight = rng.integers(1, 4, 500)
    want = collections.Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 5):
            if k[d - 1] >= 0:
                want[tuple(k[:d])] += w
    rows, places, weights = collocations.quicksort(keys, weight, [10] * 6)
    assert {tuple(keys[r, :p].tolist()): w for r, p, w in zip(rows, places, weights)} == {k: w for k, w in want.items() if w >= 10}
