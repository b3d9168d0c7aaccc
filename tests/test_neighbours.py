"""Exact neighbours by cells against brute force: clusters, copies, zeros, ties, chunks, groups and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import neighbours


def brute(queries, base, k):
    size = max((len(v) for _, v, _ in base if v is not None), default=0)
    good = lambda v: v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)
    base = [(i, neighbours.unit(np.array([v], float))[0], y) for i, v, y in base if good(v)]
    out = []
    for q, v in queries:
        if good(v):
            u = neighbours.unit(np.array([v], float))[0]
            ranked = sorted((-round(float(u @ b), 6) + 0.0, i, y) for i, b, y in base)[:k]
            out += [(q, i, -s + 0.0, y, p + 1) for p, (s, i, y) in enumerate(ranked)]
    return sorted(out)


def clusters(n, d, seed, spread=0.05, kinds=12):
    rnd = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(kinds, d))
    return [[float(x) for x in centres[k % kinds] + spread * rnd.normal(size=d)] for k in range(n)]


SCHEMA = "id long, v array<double>"


@pytest.mark.parametrize(("spread", "settings"), [(0.05, {}), (0.05, {"CELL": 8, "CHUNK": 7, "GROUP": 9, "ROWS": 5}), (3.0, {"CELL": 20, "PIVOTS": 6, "CHUNK": 30, "GROUP": 15}), (0.05, {"CELL": 10, "BROADCAST_ROWS": 0})])
def test_against_brute_force(spark, monkeypatch, tmp_path, spread, settings):
    for name, value in settings.items():
        monkeypatch.setattr(neighbours, name, value)
    base = [(k, v, k % 2) for k, v in enumerate(clusters(150, 6, 1, spread))]
    base += [(1000 + k, base[3][1], 1) for k in range(40)] + [(2000, [0.0] * 6, 1), (2001, [0.0] * 6, 0), (2002, None, 1), (2003, [1.0], 0), (2004, [float("nan")] * 6, 1), (2005, [None] * 6, 1)]
    queries = [(k, v) for k, v in enumerate(clusters(40, 6, 2, spread))] + [(100, base[3][1]), (101, [0.0] * 6), (102, None), (103, [2.0]), (104, [float("inf")] * 6)]
    q, b = spark.createDataFrame(queries, SCHEMA).repartition(3), spark.createDataFrame(base, SCHEMA + ", y int").repartition(4)
    for k in (1, 7):
        got = sorted(tuple(r) for r in neighbours.nearest(q, b, k, folder=f"file://{tmp_path}/k{k}").collect())
        want = brute(queries, base, k)
        assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)


def test_far_cells_are_ruled_out(spark, monkeypatch):
    """Of tight clusters a query meets few of the cells."""
    monkeypatch.setattr(neighbours, "CELL", 20)
    base = spark.createDataFrame([(k, v, 0) for k, v in enumerate(clusters(600, 8, 1, 0.01))], SCHEMA + ", y int")
    cells = neighbours.Cells(base)
    asked = []
    met = cells.met
    cells.met = lambda queries, k: (asked.append(queries.select(F.sum(F.size("cells"))).first()[0] or 0), met(queries, k))[1]
    cells.nearest(spark.createDataFrame([(k, v) for k, v in enumerate(clusters(50, 8, 2, 0.01))], SCHEMA), 3).collect()
    assert len(cells.pivots) >= 20 and sum(asked) < 50 * len(cells.pivots) / 3


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA + ", y int"), spark.createDataFrame([(1, [1.0, 0.0], 1)], SCHEMA + ", y int")
    assert neighbours.nearest(some, none, 3).count() == 0 and neighbours.nearest(none, some, 3).count() == 0
    assert [tuple(r) for r in neighbours.nearest(some, some, 3).collect()] == [(1, 1, 1.0, 1, 1)]
    zeros = spark.createDataFrame([(1, [0.0, 0.0], 1)], SCHEMA + ", y int")
    assert [tuple(r) for r in neighbours.nearest(some, zeros, 3).collect()] == [(1, 1, 0.0, 1, 1)]
