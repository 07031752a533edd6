from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reachway.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    fine = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in sorted(fine, key=lambda r: (r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (i, v, y))
    out = []
    for i, v, y in anchors.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in fine if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            found = [s for s in scored if s[2] != y and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(found)]
    return Counter(out)


def run(spark, rows, every=100, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = H.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, out.collect()))


def vectors(n, dims, seed, scale=lambda rnd: 1.0, labels=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = scale(rnd)
        out.append((i, [rnd.gauss(0.1, 0.3) * s for _ in range(dims)], rnd.randrange(labels)))
    return out


def test_random_tables(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 64)
    monkeypatch.setattr(H, "BLOCK", 8)
    monkeypatch.setattr(H, "ROUND", 16)
    for rows in (vectors(700, 16, 1), vectors(700, 8, 2, lambda rnd: rnd.choice([0.1, 1, 5, 40])), vectors(500, 3, 3, lambda rnd: 0.02)):
        want = brute(rows, every=20)
        assert run(spark, rows, every=20) == want and want


def test_skew_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 50)
    rnd = random.Random(4)
    rows = [(i, [0.5, 0.25, 0.1], rnd.randrange(3)) for i in range(300)]  # one vector for all: nothing but ties
    rows += vectors(200, 3, 5)[1:] and [(1000 + i, v, y) for i, v, y in vectors(200, 3, 5)]
    rows += [(2000, None, 1), (2100, [0.1, None, 0.2], 1), (2200, [float("nan"), 1.0, 1.0], 1), (2300, [float("inf"), 0.0, 0.0], 2), (2400, [0.3, 0.3, 0.3], None), (None, [0.3, 0.3, 0.3], 1), (2500, [], 1), (2600, [0.7], 1), (2700, [0.1] * 6, 2)]
    rows += [(2800, [-0.5, -0.5, -0.5], 77), (2801, [0.9, 0.9, 0.9], 77), (2900, [0.0, 0.0, 0.0], 78), (2901, [0.0, 0.0, 0.0], 78), (3000, [0.2, 0.2, 0.2], 99)]
    rows += [(1, [0.5, 0.25, 0.1], 0), (100, [0.9, 0.1, 0.1], 1), (100, [0.9, 0.1, 0.1], 1), (5, [0.45, 0.2, 0.1], 2), (5, [0.45, 0.2, 0.1], 2)]
    padded = [(i, v if v is None else [*v, *[0.0] * (6 - len(v))], y) for i, v, y in rows]
    assert run(spark, rows) == brute(padded)


def test_waves(spark, monkeypatch):
    """Many tasks: the first wave's scores bound what the second gives."""
    monkeypatch.setattr(H, "BUCKET", 20)
    rows = vectors(900, 8, 12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    given = []
    monkeypatch.setattr(H, "_wave", lambda *a, own=H._wave: given.append(own(*a).checkpoint()) or given[-1])
    try:
        want = brute(rows, every=60)
        assert run(spark, rows, every=60) == want and want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(given) == 4 and given[2].count() + given[3].count() < 0.7 * 25 * 15 * 5 * 10


def test_options(spark):
    rows = vectors(400, 6, 8)
    want = brute(rows, every=50, positives=2, negatives=3, low=10, high=60)
    assert run(spark, rows, every=50, positives=2, negatives=3, low=10, high=60) == want and want


def test_empty_and_too_large(spark):
    assert not run(spark, [])
    assert not run(spark, [(1, [0.5], 1), (2, [0.5], 1)])
    with pytest.raises(Exception, match="exact|large"):
        run(spark, [(0, [1e20], 1), (1, [1.0], 1)])


def test_pruned_buckets_are_not_multiplied(monkeypatch):
    rnd = np.random.default_rng(1)

    def pack(n, scale, first):
        v = np.floor(256 * rnd.normal(0.5, 0.1, (n, 4)) * scale).astype(np.int16)
        norms = np.sqrt((v.astype(float) ** 2).sum(1))
        none = np.full(n, H.NONE, np.int64).tobytes()
        return H.Packed(4, (first + np.arange(n)).tobytes(), np.zeros(n, np.int64).tobytes(), v.tobytes(), norms.tobytes(), none, none), norms.max()

    block, _ = pack(3, 1.0, 0)
    search = H.Search(block, 5, None)
    search.add(*pack(100, 1.0, 10))
    calls = []
    monkeypatch.setattr(H, "_scores", lambda a, b: calls.append(len(a)) or a @ b.T)
    search.add(*pack(100, 0.1, 1000))
    assert not calls


def test_report_against_sql(spark):
    rows = [(i, v, y if i % 31 else None) for i, v, y in vectors(450, 8, 9, labels=10)] + [(7000, None, 3), (7100, [0.5] * 8, 3), (7200, [float("nan")] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    got = H.negatives_report(df)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({H.ORACLE})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
