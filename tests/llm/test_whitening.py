"""Operator 13 against NumPy and whole numbers in Python."""

from __future__ import annotations

import numpy as np
import pytest

from glyphmill.llm import whitening


def brute(rows, k=4):
    good = [(key, v) for key, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in good]
    fit = np.array(sorted({tuple(v) for v in x}))
    n, s = len(fit), [sum(int(v) for v in c) for c in fit.T]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (key, _), v in zip(good, x, strict=True):
        deviation = sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True))
        white = (np.array(v) - fit.mean(0)) @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(key, c + 1, n, deviation, white[c], values[c] / values.sum()) for c in range(k)]
    return out


def vectors(n=300, d=6, seed=4):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d)) @ np.diag([3.0, 2, 1.5, 1, 0.5, 0.2][:d]) + 5
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    return [*rows, *[(1000 + k, rows[0][1]) for k in range(150)], (7, None), (8, [None] * d), (9, [float("nan")] + [0.0] * (d - 1)), (10, [0.0] * (d - 1) + [float("-inf")]), (None, rows[1][1])]


@pytest.mark.parametrize("parts", [1, 9])
def test_against_numpy(spark, folder, parts):
    rows = vectors()
    path = folder("vectors", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts))
    got = sorted(whitening.op13_whitening(spark, path).collect(), key=lambda r: (str(r.vec_id), r.component))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[1]))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9)
    for c in range(1, 5):
        ours, theirs = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_chan_is_the_whole(spark):
    rnd = np.random.default_rng(0)
    x = rnd.integers(-(1 << 40), 1 << 40, (50, 3)) + (1 << 50)
    parts = [whitening.moments(p) for p in (x[:1], x[1:20], x[20:])]
    m = whitening.merged(parts[0], whitening.merged(parts[1], parts[2]))
    assert m.n == 50 and m.sums == [sum(map(int, c)) for c in x.T]
    exact = [[sum((50 * int(a) - s) * (50 * int(b) - t) for a, b in zip(p, q, strict=True)) / 2500 for q, t in zip(x.T, m.sums, strict=True)] for p, s in zip(x.T, m.sums, strict=True)]
    assert np.allclose(m.scatter, exact, rtol=1e-9)


def test_deviations_beyond_a_product_of_longs_are_exact():
    x = np.array([[1 << 30, 5], [-(1 << 30), 7], [0, 0]])
    m = whitening.Whitening(2, [1 << 20, 12], np.zeros(2), np.eye(2), np.ones(2), 2.0)
    want = [sum((2 * int(c) - s) ** 2 for c, s in zip(v, m.sums, strict=True)) for v in x]
    assert list(m.deviations(x)) == want


def test_odd_vectors(spark, edge_dir):
    """Nulls and entries that are no numbers go; other lengths, an empty vector and a row without an id stay."""
    rows = whitening.op13_whitening(spark, edge_dir).collect()
    assert sorted({(r.vec_id is None, r.vec_id) for r in rows}, key=str) == [(False, 1), (False, 6), (False, 7), (False, 8), (False, 9), (True, None)]
    assert len(rows) == 7 * 3  # three dimensions; vec_id 1 is there twice
    assert all(r.n is None and r.whitened is None and r.deviation is None for r in rows if r.vec_id in (8, 9))
    assert all(r.n == 4 and r.whitened is not None for r in rows if r.vec_id not in (8, 9))


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(one).collect()} == {(1, 0, None, 0.0, None)}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert {r.whitened is None for r in rows if r.component == 2} == {True} and all(r.identity_error < 1e-9 for r in rows)
