"""Bootstrap intervals against resampled rows, cell by cell and replicate by replicate."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from glyphmill.operators import bootstrap


def curves(rows):
    """AUROC and AUPR of (score, y) rows, sorted with ties in order; row by row."""
    order = sorted(range(len(rows)), key=lambda k: -rows[k][0])
    pos = sum(y for _, y in rows)
    neg = len(rows) - pos
    wins = sum((a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y)
    area, tp, k, before = 0.0, 0, 0, 1.0
    for i in order:
        tp, k = tp + rows[i][1], k + 1
        if rows[i][1]:
            area += (tp / k + before) / 2
        before = tp / k
    return wins / (pos * neg) if pos * neg else math.nan, area / pos if pos else math.nan


def data(n=80, seed=1):
    rnd = random.Random(seed)
    return [(k, round(rnd.random(), 1 if k % 2 else 3), int(rnd.random() < 0.4)) for k in range(n)]


def test_replicates_are_those_of_weighted_rows(spark):
    """A replicate is the table in which every cell's first row stands as often as the cell weighs."""
    rows = data()
    got = bootstrap.replicates(spark.createDataFrame(rows, "id long, prob double, y int").repartition(5), iterations=12)
    cells = {}
    for k, p, y in rows:
        cells.setdefault((p, y), []).append(k)
    keys = sorted(cells, key=lambda c: (-c[0], min(cells[c])))
    w = bootstrap.weights(np.array([str(min(cells[c])) for c in keys]), np.array([len(cells[c]) for c in keys]), 12, bootstrap.rng.SEED)
    for r in range(12):
        made = [c for c, times in zip(keys, w[:, r], strict=True) for _ in range(times)]
        auroc, aupr = curves(made)
        tp, fp, fn = (sum(1 for p, y in made if (p >= 0.5) == up and y == one) for up, one in ((True, 1), (True, 0), (False, 1)))
        assert got["auroc"][r] == pytest.approx(auroc) and got["aupr"][r] == pytest.approx(aupr)
        assert got["f1"][r] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and got["acc"][r] == pytest.approx((len(made) - fp - fn) / len(made))


@pytest.mark.parametrize("n", [1, 3, 1000, 100_000])
def test_weights_are_poisson(n):
    w = bootstrap.weights(np.array([str(k) for k in range(60)]), np.full(60, n), 200, 7).ravel()
    assert w.min() >= 0 and w.mean() == pytest.approx(n, abs=5 * math.sqrt(n / w.size)) and w.var() == pytest.approx(n, rel=0.08)


def test_harmonic_numbers_far_out():
    n = np.array([-1, 0, 1, 5, bootstrap.HARMONIC - 1, bootstrap.HARMONIC, 3 * bootstrap.HARMONIC])
    assert np.allclose(bootstrap.harmonic(n), [math.fsum(1 / k for k in range(1, x + 1)) for x in n], rtol=1e-13)


def test_work_does_not_grow_with_rows(spark):
    """A thousand copies of every row are as many cells, and intervals some thirty times narrower."""
    df = spark.createDataFrame(data(60), "id long, prob double, y int")
    many = df.join(spark.range(1000).withColumnRenamed("id", "copy")).selectExpr("id * 1000 + copy AS id", "prob", "y")
    assert bootstrap.cells(many, "id", "prob", "y").count() == bootstrap.cells(df, "id", "prob", "y").count()
    one, other = bootstrap.intervals(df).first(), bootstrap.intervals(many).first()
    for m in ("acc", "f1", "auroc", "aupr"):
        wide, narrow = one[f"{m}_hi"] - one[f"{m}_lo"], other[f"{m}_hi"] - other[f"{m}_lo"]
        assert 10 * narrow < wide and one[f"{m}_lo"] <= other[f"{m}_mean"] <= one[f"{m}_hi"]


def test_odd_tables(spark):
    schema = "id long, prob double, y int"
    none = bootstrap.intervals(spark.createDataFrame([], schema)).first()
    assert set(none) == {None}
    ones = bootstrap.intervals(spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, None, 1), (4, float("nan"), 0), (5, 0.5, None)], schema)).first()
    assert ones.auroc_mean is None and ones.aupr_mean == ones.acc_lo == 1.0
    zeros = bootstrap.intervals(spark.createDataFrame([(k, 0.1 * k, 0) for k in range(5)], schema)).first()
    assert zeros.aupr_hi is None and zeros.auroc_lo is None and zeros.f1_mean == 0.0
