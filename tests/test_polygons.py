"""Polygons of several parts with holes, against a plain even-odd test with exact fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from reachway.functions import geo
from reachway.operators import quality
from reachway.sources import geoparquet

RINGS = "array<array<struct<x:double,y:double>>>"


def plain(rings, x, y):
    """Inside by the even-odd rule, and not on an edge."""
    x, y, odd = Fraction(x), Fraction(y), False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            x1, y1, x2, y2 = map(Fraction, (x1, y1, x2, y2))
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def star(rnd, cx, cy, r, n):
    """Corners on a grid of 1/64, so that points fall on edges and corners too."""
    return [(round((cx + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / n)) * 64) / 64, round((cy + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) * 64) / 64) for i in range(n)]


def shapes():
    rnd = random.Random(7)
    box = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    out = {"lake": [box(0, 0, 4), box(0, 0, 2)], "island in a lake": [box(0, 0, 4), box(0, 0, 2), box(0, 0, 1)], "two": [box(-2, 0, 1), box(3, 1, 1)], "closed": [[*box(0, 0, 3), (-3, -3)]], "diamond": [[(0, -4), (4, 0), (0, 4), (-4, 0)]]}
    for k in range(6):
        out[f"star {k}"] = [star(rnd, 0, 0, 4, rnd.choice([5, 40, 300])), star(rnd, 9, 0, 2, 12)]
    out["flat"] = [[(-1, 1), (3, 1), (1, 1)]]
    return out


def points(rnd):
    return [(rnd.choice([rnd.uniform(-5, 12), rnd.randrange(-320, 768) / 64, rnd.randrange(-5, 12)]), rnd.choice([rnd.uniform(-5, 5), rnd.randrange(-320, 320) / 64, rnd.randrange(-5, 6)])) for _ in range(400)]


def table(spark, polygons):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in polygons.items()]
    return spark.createDataFrame(rows, f"ubigeo string, rings {RINGS}")


def test_even_odd_over_strips(spark, monkeypatch):
    monkeypatch.setattr(quality, "STRIP_EDGES", 3)
    polygons, rnd = shapes(), random.Random(3)
    rows = [(i, k, float(x), float(y)) for k in polygons for i, (x, y) in enumerate(points(rnd))] + [(0, "none", 0.0, 0.0), (1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, d string, lon double, lat double")
    both = table(spark, polygons)
    got = {(r.id, r.d): r.flag_fuera_de_poligono for r in quality.flag_outside_polygon(df, both.unionByName(both), "d").collect()}
    assert len(got) == len(rows)
    want = {(i, k): k in polygons and not plain(polygons[k], x, y) for i, k, x, y in rows}
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, wrong[:5]
    assert {got[i, k] for i, k in got if k == "lake"} == {True, False}


def test_one_ring_columns_still_work(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    df = spark.createDataFrame([(1, "a", 0.7, 0.3), (2, "a", 0.3, 0.7), (3, "b", 0.5, 0.5), (4, "c", 0.5, 0.5)], "id int, d string, lon double, lat double")
    polygons = spark.createDataFrame([("a", ring), ("b", None), ("c", [])], "ubigeo string, ring array<struct<x:double,y:double>>")
    assert {r.id: r.flag_fuera_de_poligono for r in quality.flag_outside_polygon(df, polygons, "d").collect()} == {1: False, 2: True, 3: False, 4: False}


def test_parts_and_binary_round_trip(spark, tmp_path):
    polygons = {k: v for k, v in shapes().items() if k not in ("closed", "flat")}
    assert [len(p) for p in geo.polygon_parts(polygons["island in a lake"])] == [2, 1]
    assert [len(p) for p in geo.polygon_parts(polygons["two"])] == [1, 1]
    geoparquet.write_geoparquet(table(spark, polygons), str(tmp_path / "g"))
    back = {r.ubigeo: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in geoparquet.read_geoparquet(spark, str(tmp_path / "g")).collect()}
    rnd = random.Random(9)
    for k, rings in polygons.items():
        assert sorted(map(len, back[k])) == sorted(len(r) + 1 for r in rings)
        for x, y in points(rnd)[:100]:
            assert plain(back[k], x, y) == plain(rings, x, y)


def test_hot_polygon_is_dealt_by_strips(spark, monkeypatch):
    monkeypatch.setattr(quality, "STRIP_EDGES", 2)
    rnd = random.Random(2)
    _, strips = quality.polygon_strips(table(spark, {"a": [star(rnd, 0, 0, 4, 200)]}), "ubigeo")
    sizes = [r.n for r in strips.select(F.size("__edges").alias("n")).collect()]
    assert len(sizes) > 50 and max(sizes) < 60
