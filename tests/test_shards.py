"""Scoring of a shard, stored pieces, fuzzy expansion and the status of questions, against plain versions."""
from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import scoring
from graphloom.operators import search as S
from graphloom.plans import pipeline as P
from graphloom.plans import queries as Q

DOCS, K = 600, 5


def shard(rng):
    held = {}
    for tid in range(40):
        n = rng.choice([1, 3, 20, 400, 590])
        held[tid * 7] = {d: round(rng.random(), 1) for d in rng.sample(range(DOCS), n)}
    held[1000] = {DOCS - 1: 0.5}
    rows = list(held.items())
    rng.shuffle(rows)
    return held, scoring.Shard(pa.table({"tid": pa.array([t for t, _ in rows], pa.int64()), "locs": pa.array([list(p) for _, p in rows], pa.list_(pa.int32())),
                                         "imps": pa.array([list(p.values()) for _, p in rows], pa.list_(pa.float64()))}))


def test_best_of_a_shard_is_that_of_all_pairs():
    rng = random.Random(5)
    held, own = shard(rng)
    for _ in range(300):
        tids = rng.sample(sorted(held), rng.choice([1, 2, 4, 12]))
        weights = {t: 8.0 if len(held[t]) < 50 else rng.choice([0.01, 0.3]) for t in tids}
        banned = rng.sample(sorted(set(held) - set(tids)), rng.choice([0, 1, 3]))
        rows, w = own.rows(np.array(tids)), np.array([weights[t] for t in tids])
        sums = {d: sum(weights[t] * held[t][d] for t in tids if d in held[t]) for d in range(DOCS) if any(d in held[t] for t in tids)}

        def best(found):
            return sorted(((d, round(s, 9)) for d, s in found.items()), key=lambda x: (-x[1], x[0]))[:K]

        def shown(found):
            docs, scores = scoring._best(*found, K)
            return sorted(((int(d), round(float(s), 9)) for d, s in zip(docs, scores)), key=lambda x: (-x[1], x[0]))

        assert shown(own.any(rows, w, K)) == best(sums)
        free = {d: s for d, s in sums.items() if not any(d in held[t] for t in banned)}
        assert shown(own.without(*own.any(rows, w, None), own.rows(np.array(banned, np.int64)))) == best(free)
        groups = np.array([t % 3 for t in tids])
        every = {d: s for d, s in sums.items() if all(any(d in held[t] for t in tids if t % 3 == g) for g in set(groups.tolist()))}
        assert shown(own.all(rows, w, groups)) == best(every)
    assert own.rows(np.array([3, 1000])).tolist()[0] == -1


def test_an_index_writes_only_what_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (None, "a"), (None, None)], "id int, body string")
    index = S.build_index(docs, ["id"], {"body": F.col("body")}).checkpoint()
    got = {(r.id, r.term): (r.tf, len(r.positions)) for r in index.postings.collect()}
    assert got == {(1, "a"): (2, 2), (1, "b"): (2, 2), (1, "c"): (1, 1), (None, "a"): (1, 1)}
    assert not {"blocks", "terms", "shards", "term_df"} & set(vars(index))


def test_fuzzy_finds_all_terms_within_two_edits(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 8))) for _ in range(400)})
    index = S.build_index(spark.createDataFrame([(1, " ".join(words))], "id int, body string"), ["id"], {"body": F.col("body")})
    asked = words[::9] + ["abababababab"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = {(r.q, r.term, r.edits) for r in S.expand_fuzzy(index, spark.createDataFrame([(w, w) for w in asked], "q string, word string"), "q", "word").collect()}
    assert got == {(q, t, e) for q in asked for t in words if (e := edits(q, t)) <= 2}


def test_the_status_of_questions_needs_no_call_chains(spark, monkeypatch):
    def never(*_):
        raise AssertionError("calls asked for")

    monkeypatch.setattr(P, "settled_calls", never)
    assert Q.REGISTRY["question_status"](spark, "/root/testdata/sf0.001").count() > 0
