from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachway.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(p, y):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def walk(model, x):
    """One row through one tree at a time."""
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + (2 if x[model.feature[t, node]] > model.threshold[t, node] else 1)
        total += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_walk_alike():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(1500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    m = quality.fit(x[:1000], y[:1000], trees=30)
    p = m.score(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.95
    assert np.allclose(p[:40], [walk(m, r) for r in x[1000:1040]])


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0.0]])
def test_models_without_two_labels_are_constant(y):
    m = quality.fit(np.zeros((len(y), len(quality.FEATURES))), np.array(y, float))
    assert np.ptp(m.score(np.random.default_rng(0).normal(size=(5, len(quality.FEATURES))))) == 0
    n = toxicity.fit(["some text"] * len(y), np.array(y, float))
    assert np.ptp(n.score(["a", None, "", "b c d"])) == 0 and 0 < n.score(["a"])[0] < 1


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "\n\n", "é", "\ud800", "a" * 100_000, "x y\n" * 20_000):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()


def _report(spark, module, report, label, parts, held):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    out = report(docs, labels)
    rows = out.join(labels.select("doc_id", label), "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    test = rows[rows.held_out & rows[label].notna()]
    assert abs(rows.held_out.mean() - 1 / parts) < 0.03
    return test.score.to_numpy(), test[label].to_numpy()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_quality(spark):
    p, y = _report(spark, quality, quality.quality_report, "quality", 4, 2)
    assert auc(p, y) > 0.97 and ((p >= 0.7) == y).mean() > 0.94


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_toxicity(spark):
    p, y = _report(spark, toxicity, toxicity.toxicity_report, "toxic", 3, 1)
    assert auc(p, y) > 0.95 and (p[y == 1] >= 0.7).mean() > 0.8 and (p[y == 0] >= 0.7).mean() < 0.02


def test_held_out_labels_do_not_count(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1), "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality")
    other = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, other))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.threshold, b.threshold)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, None), (2, "", 5)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for out in (quality.scored(docs, quality.train(docs, labels)), toxicity.scored(docs, toxicity.train(docs, labels))):
        assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 4 and out.filter("score IS NULL").count() == 0
    assert quality.scored(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_windows_cover_all_words():
    sizes = np.array([0, 1, 31, 32, 33, 48, 49, 500, 0, 64])
    start, length, doc = toxicity.windows(sizes)
    base = np.cumsum(sizes) - sizes
    for d, n in enumerate(sizes):
        seen = np.zeros(n, bool)
        for s, m in zip(start[doc == d], length[doc == d], strict=True):
            assert 0 < m <= toxicity.WINDOW and s >= base[d] and s + m <= base[d] + n
            seen[s - base[d] : s - base[d] + m] = True
        assert seen.all()
        assert (np.diff(start[doc == d]) == toxicity.STRIDE).all()


def test_gradients_of_the_network():
    rnd = np.random.default_rng(5)
    net = toxicity.Network.new(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    length = np.array([32, 5, 1])
    mask = (np.arange(toxicity.WINDOW)[:, None] < length)[:, :, None].astype(float)
    x = {d: rnd.normal(size=(toxicity.WINDOW, 3, 3 * toxicity.HIDDEN)) * mask for d in "fb"}
    up = rnd.normal(size=3)
    _, saved = net.run(x, mask, keep=True)
    g, dx = net.gradients(mask, saved, up)

    def loss():
        return float(net.run(x, mask)[0].astype(np.float64) @ up)

    for name in ("uf", "ub", "a", "v", "o"):
        at = tuple(rnd.integers(0, s) for s in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        hi = loss()
        net.p[name][at] = old - 1e-3
        lo = loss()
        net.p[name][at] = old
        assert (hi - lo) / 2e-3 == pytest.approx(g[name][at], rel=0.02, abs=2e-3), name
    for d in "fb":
        for t, w in ((0, 1), (4, 1), (20, 0), (31, 0)):
            k = int(rnd.integers(0, 3 * toxicity.HIDDEN))
            old = x[d][t, w, k]
            x[d][t, w, k] = old + 1e-2
            hi = loss()
            x[d][t, w, k] = old - 1e-2
            lo = loss()
            x[d][t, w, k] = old
            assert (hi - lo) / 2e-2 == pytest.approx(dx[d][t, w, k], rel=0.03, abs=2e-3)


def test_words_are_hashed_alike_in_any_company():
    words = ["a", "ab", "abc", "straße", "xyzxyz", "日本語"]
    f, s = toxicity.word_features(words)
    for i, w in enumerate(words):
        g, t = toxicity.word_features([w])
        assert np.array_equal(np.sort(f[s[i] : s[i + 1]]), np.sort(g[t[0] : t[1]]))


def test_long_texts_and_order():
    rnd = random.Random(0)
    texts = [" ".join(rnd.choice(["good", "fine", "day", "sun"]) for _ in range(60)) + (" vile" if i % 2 else "") for i in range(300)]
    y = np.array([i % 2 for i in range(300)], float)
    net = toxicity.fit(texts, y)
    long = "fine day " * 30_000
    p = net.score([long, long + " vile " + long, "", None])
    assert p[0] < 0.5 < p[1] and p[2] == p[3] < 0.5
    assert np.allclose(net.score(texts[:9]), [net.score([t])[0] for t in texts[:9]], atol=1e-5)
