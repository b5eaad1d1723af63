"""Whitened embeddings against a plain version in fractions."""
import random
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import queries, whitening
from helpers import ordered

SCHEMA = "vec_id long, embedding array<float>, component int, n long, code string"


def brute(rows, components=16):
    """(id, n, deviation, eigenvalues, centred vectors, covariance) of the rows that stay."""
    good = [(r[0], tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r[1])) for r in rows
            if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    if not good:
        return [], 0, None
    sizes = [len(x) for _, x in good]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [g for g in good if len(g[1]) == dim]
    fit = sorted({x for _, x in good})
    n = len(fit)
    total = [sum(x[i] for x in fit) for i in range(dim)]
    cov = [[float(sum((Fraction(x[i]) - Fraction(total[i], n)) * (Fraction(x[j]) - Fraction(total[j], n)) for x in fit) / n) for j in range(dim)] for i in range(dim)]
    out = [(i, sum((n * x[k] - total[k]) ** 2 for k in range(dim)), [float(Fraction(x[k]) - Fraction(total[k], n)) for k in range(dim)]) for i, x in good]
    return out, n, np.array(cov)


def vectors(seed=3, n=60, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1 + k) for k in range(dim)], i % 3, i, "x") for i in range(n)]
    rows += [(100 + i, rows[0][1], None, None, None) for i in range(30)] + [rows[5], rows[5]]
    rows += [(200, None, 1, 1, ""), (201, [], 1, 1, ""), (202, [1.0] * (dim - 1) + [None], 1, 1, ""), (203, [float("nan")] * dim, 1, 1, ""),
             (204, [float("inf")] + [0.0] * (dim - 1), 1, 1, ""), (205, [1.0, 2.0], 1, 1, ""), (None, [0.5] * dim, None, None, None), (None, None, None, None, None)]
    return rows


def held(got, rows, components):
    want, n, cov = brute(rows)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    count = min(components, len(values))
    assert len(got) == len(want) * count
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    for i, deviation, centred in want:
        own = by[i, deviation]
        for c in range(count):
            r = own[c + 1][0]
            assert (r.n, r.deviation_exact) == (n, str(deviation))
            assert r.explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(float(np.dot(centred, basis[:, c])) / values[c] ** 0.5), abs=1e-8)
            assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_against_fractions(spark):
    rows = vectors()
    held(whitening.whiten(spark.createDataFrame(rows, SCHEMA), 4).collect(), rows, 4)


def test_large_entries_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1e9), rng.gauss(0, 3e9), rng.gauss(0, 1.0)], 0, 0, "") for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 3).collect()
    want = {i: d for i, d, _ in brute(rows)[0]}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)


def test_white_covariance(spark):
    rows = [r for r in vectors() if r[0] is not None and r[0] < 60]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 6).collect()
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r.whitened
    m = np.array([[v[c] for c in range(1, 7)] for v in table.values()])
    assert np.abs(m.T @ m / len(m) - np.eye(6)).max() < 1e-9 and np.abs(m.mean(0)).max() < 1e-9


def test_nothing_varies(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, ""), (2, [1.0, 2.0], 0, 0, "")], SCHEMA)
    got = whitening.whiten(one).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in got)
    flat = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, ""), (2, [3.0, 2.0], 0, 0, "")], SCHEMA)
    got = ordered((r.vec_id, r.component, r.whitened if r.whitened is None else abs(r.whitened)) for r in whitening.whiten(flat).collect())
    assert got == ordered([(1, 1, 1.0), (2, 1, 1.0), (1, 2, None), (2, 2, None)])
    none = whitening.whiten(one.limit(0))
    assert none.count() == 0 and none.schema == whitening.whiten(one).schema
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 0, "")], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.REGISTRY["op11_whitening"](spark, sf)
    rows = [tuple(r) for r in queries.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()][:]
    found = got.collect()
    assert len(found) == 16 * len(rows)
    x = np.array([[np.floor(64 * float(c)) for c in r[1]] for r in rows])
    x = np.unique(x, axis=0)
    n = len(x)
    assert {r.n for r in found} == {n}
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    for r in found[:200]:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
        assert r.identity_error < 1e-4
