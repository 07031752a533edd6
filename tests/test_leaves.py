"""Nearest points by quadtree leaves: crowded places, lines, single places, far points."""

from __future__ import annotations

import numpy as np
import pytest

from reachway.operators import leaves, modes


def brute(p, t, k, skip):
    out = set()
    for i, x, y in p:
        ids, tx, ty = (np.array(c) for c in zip(*[r for r in t if not (skip and r[0] == i)], strict=True))
        d = np.sqrt((tx - x) ** 2 + (ty - y) ** 2)
        for r, j in enumerate(np.lexsort((ids, d))[:k].tolist()):
            out.add((i, r + 1, int(ids[j]), round(float(d[j]), 9)))
    return out


def crowd(rng, n):
    """90 % of the points within a millionth of the extent."""
    near = rng.random(n) < 0.9
    return np.where(near, 5 + rng.random(n) * 1e-5, rng.random(n) * 100), np.where(near, 7 + rng.random(n) * 1e-5, rng.random(n) * 100)


SHAPES = {
    "crowd": crowd, "line": lambda rng, n: (np.full(n, 3.0), rng.random(n)), "few places": lambda rng, n: (rng.integers(0, 3, n).astype(float), rng.integers(0, 2, n).astype(float)), "one place": lambda rng, n: (np.ones(n), np.ones(n)),
    "two clusters": lambda rng, n: (np.where(rng.random(n) < 0.5, 0, 1e6) + rng.random(n), rng.random(n)),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("k,skip", [(1, False), (5, True)])
def test_equal_to_brute_force(spark, shape, k, skip, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 16)
    monkeypatch.setattr(leaves, "POINTS", 40)
    rng = np.random.default_rng(3)
    x, y = SHAPES[shape](rng, 700)
    t = [(int(i), float(a), float(b)) for i, a, b in zip(rng.permutation(700), x, y, strict=True)]
    p = t[:150] if skip else [(1000 + i, *t[i % 700][1:]) for i in range(60)] + [(2000 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((60, 2)) * 120 - 10)]
    points, targets = (spark.createDataFrame(v, "id long, x double, y double").repartition(3) for v in (p, t))
    got = leaves.nearest_by_leaves(points, targets, len(t), k, skip, leaf=16).collect()
    assert {(r.id, r.rank, r.target, round(r.dist, 9)) for r in got} == brute(p, t, k, skip) and len(got) == len(p) * k


def test_leaves_are_bounded_wherever_targets_crowd():
    rng = np.random.default_rng(1)
    x, y = crowd(rng, 20_000)
    codes = np.sort(leaves.curve(x, y, (0, 100, 0, 100)))
    for c in (codes, np.zeros(1000, np.int64), np.arange(100)):
        found = leaves.cells(c, 64)
        assert max(b - a for a, b in found) <= 64 and [a for a, _ in found] == [0, *[b for _, b in found][:-1]] and found[-1][1] == len(c)
    assert len(leaves.cells(codes, 64)) < 20_000 / 64 * 8


def test_no_large_group_for_crowded_points(spark, monkeypatch):
    """All points at one leaf: chunks of about POINTS meet copies of it."""
    monkeypatch.setattr(leaves, "POINTS", 50)
    sizes = []
    monkeypatch.setattr(leaves, "_met", lambda pairs, table, k, skip, own=leaves._met: sizes.append(pairs.groupBy("leaf").count().agg({"count": "max"}).first()[0]) or own(pairs, table, k, skip))
    rng = np.random.default_rng(2)
    x, y = crowd(rng, 3000)
    t = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    p = [(i, 5 + float(a) * 1e-8, 7 + float(b) * 1e-8) for i, (a, b) in enumerate(rng.random((2000, 2)))]
    points, targets = (spark.createDataFrame(v, "id long, x double, y double") for v in (p, t))
    got = leaves.nearest_by_leaves(points, targets, len(t), 1, False, leaf=64)
    plan = got._jdf.queryExecution().toString()
    assert "chunk" in plan and sizes[0] > 500
    want = {(r.id, r.target) for r in modes.nearest_points(points, targets, 1).collect()}
    assert {(r.id, r.target) for r in got.collect()} == want
