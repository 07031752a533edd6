"""Exact quantiles by rank selection against sorted values."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from reachway.operators import ranks

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def want(values, q):
    v = sorted(values)
    h = q * (len(v) - 1)
    lo, hi = math.floor(h), math.ceil(h)
    return v[lo] if lo == hi else (hi - h) * v[lo] + (h - lo) * v[hi]


def tables():
    rnd = random.Random(1)
    near = struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", 1.0))[0] + 3))[0]
    return {
        "uniform": [rnd.random() for _ in range(500)], "signs": [rnd.gauss(0, 1) * 10 ** rnd.randrange(-300, 300) for _ in range(400)], "one value": [7.5] * 300, "two": [1.0] * 200 + [2.0] * 201,
        "close": [rnd.choice([1.0, near]) for _ in range(301)], "single": [3.0], "pair": [-1.0, 4.0], "zeros": [0.0, -0.0] * 40, "whole": [float(rnd.randrange(-50, 50)) for _ in range(600)], None: [float(i) for i in range(100)],
    }


@pytest.mark.parametrize("small,broadcast", [(1, 200_000), (20, 0), (4_096, 200_000)])
def test_groups(spark, small, broadcast):
    groups = tables()
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("all null", None)] * 3 + [("uniform", None)] * 5
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.q for r in ranks.group_quantiles(df, "v", QS, ["g"], small, broadcast).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx([want(vs, q) for q in QS], rel=1e-15, abs=0), g


def test_two_keys_against_the_built_in_percentile(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice([1, 2, None]), rnd.choice("xy"), rnd.gauss(0, 5) if rnd.random() < 0.9 else None) for _ in range(3000)], "a int, b string, v double")
    got = {(r.a, r.b): r.q for r in ranks.group_quantiles(df, "v", [0.3, 0.5], ["a", "b"], small=16).collect()}
    built_in = {(r.a, r.b): r.q for r in df.groupBy("a", "b").agg(F.percentile("v", F.array(F.lit(0.3), F.lit(0.5))).alias("q")).collect()}
    assert set(got) == set(built_in) and len(got) == 6
    assert all(got[k] == pytest.approx(built_in[k]) for k in got)


def test_whole_table_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "v double")
    assert ranks.group_quantiles(df, "v", [0.5], small=8).collect()[0].q == [500.0]
    empty = df.limit(0)
    assert [r.median for r in ranks.group_medians(empty, "v").collect()] == [None]
    assert ranks.group_quantiles(empty.withColumn("g", F.lit(1)), "v", [0.5], ["g"]).collect() == []


def test_no_task_holds_a_group(spark):
    """What is gathered is small; the plan has no percentile."""
    df = spark.range(200_000).select((F.col("id") % 7).alias("g"), (F.xxhash64("id") % 1000 / 10).cast("double").alias("v"))
    out = ranks.group_quantiles(df, "v", [0.5], ["g"], small=100)
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan
    want_ = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("q")).collect()}
    assert {r.g: r.q[0] for r in out.collect()} == pytest.approx(want_)


def test_keys_keep_the_order_of_doubles(spark):
    values = [-math.inf, -1e300, -1.5, -1e-300, -5e-324, 0.0, 5e-324, 1e-10, 1.0, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select("v", ranks.sortable(F.col("v")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
