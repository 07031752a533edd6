"""The network's scores and the trees' splits by plain loops, and the samples that models are fitted on."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachway.llm import quality, toxicity
from reachway.llm.toxicity import ATTENTION, HIDDEN, STRIDE, WINDOW, WIDTH, Network, tokens, word_features


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def embedded(net, word):
    feats, starts = word_features([word])
    own = feats[starts[0] : starts[1]]
    return [sum(float(net.p["e"][f][k]) for f in own) / math.sqrt(len(own)) for k in range(WIDTH)]


def direction(net, xs, d):
    w, u, b = (net.p[k + d].astype(float) for k in "wub")
    h, out = [0.0] * HIDDEN, []
    for x in xs:
        g = [sum(x[i] * w[i][j] for i in range(WIDTH)) + b[j] for j in range(3 * HIDDEN)]
        r = [sum(h[i] * u[i][j] for i in range(HIDDEN)) for j in range(3 * HIDDEN)]
        new = []
        for j in range(HIDDEN):
            z, reset = sigmoid(g[j] + r[j]), sigmoid(g[HIDDEN + j] + r[HIDDEN + j])
            c = math.tanh(g[2 * HIDDEN + j] + reset * r[2 * HIDDEN + j])
            new.append(z * h[j] + (1 - z) * c)
        h = new
        out.append(h)
    return out


def window_logit(net, words):
    xs = [embedded(net, w) for w in words]
    states = [f + b for f, b in zip(direction(net, xs, "f"), reversed(direction(net, xs[::-1], "b")), strict=True)]
    weight = [math.exp(sum(math.tanh(sum(s[i] * float(net.p["a"][i][k]) for i in range(2 * HIDDEN))) * float(net.p["v"][k]) for k in range(ATTENTION))) for s in states]
    pooled = [sum(w * s[i] for w, s in zip(weight, states, strict=True)) / sum(weight) for i in range(2 * HIDDEN)]
    return sum(p * float(o) for p, o in zip(pooled, net.p["o"], strict=True)) + float(net.p["c"][0])


def document_score(net, text):
    words = tokens(text)
    starts = [0]
    while starts[-1] + WINDOW < len(words):
        starts.append(starts[-1] + STRIDE)
    best = max((window_logit(net, words[s : s + WINDOW]) for s in starts if words), default=net.empty)
    return sigmoid(net.scale * best + net.shift)


def test_scores_equal_plain_loops():
    rnd, net = random.Random(4), Network.new(3)
    net.scale, net.shift = 1.7, -0.4
    for k in "vo":
        net.p[k] *= 4
    pool = ["du", "Idiot", "schönes", "wetter", "a", "x1", "überlang" * 5, "日本", "hate"]
    texts = [None, "", "...", "one", *[" ".join(rnd.choice(pool) for _ in range(n)) for n in (2, 31, 32, 33, 48, 49, 100)]]
    assert np.allclose(net.score(texts), [document_score(net, t) for t in texts], atol=2e-5)


def test_first_splits_are_the_best_by_trying_all():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(1)
    y = ((x[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, cut):
        low = x[:, f] <= cut
        if min(h[low].sum(), h[~low].sum()) < quality.LEAST_HESSIAN:
            return -1
        return sum(g[s].sum() ** 2 / (h[s].sum() + quality.PENALTY) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + quality.PENALTY)

    edges = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS)[1:-1])) for c in x.T]
    best = max((gain(f, c), f, c) for f in range(4) for c in edges[f])
    f, cut = int(model.feature[0, 0]), float(model.threshold[0, 0])
    assert f == best[1] == 2 and gain(f, cut) == pytest.approx(best[0])
    low = x[:, f] <= cut
    assert np.allclose(model.leaf[0], [-quality.RATE * g[s].sum() / (h[s].sum() + quality.PENALTY) for s in (low, ~low)])


def test_samples_are_bounded_whatever_the_repeats(spark, monkeypatch):
    docs = spark.range(300).select((F.col("id") % 30).alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 30).cast("string"), F.repeat(F.lit(" long"), (F.col("id") % 30 * 100).cast("int"))).alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, share: seen.update(texts=texts, y=y, share=share))
    toxicity.train(docs, labels)
    open_ids = labels.filter(quality.remainder(F.col("doc_id"), 3) != 1).count()
    assert len(seen["texts"]) == len(set(seen["texts"])) == open_ids and max(map(len, seen["texts"])) > 10_000
    toxicity.train(docs, labels, chars=40_000)
    assert 0 < len(seen["texts"]) < open_ids and sum(map(len, seen["texts"])) <= 40_000 and 0 < seen["y"].sum() < len(seen["y"])
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.update(x=x, y=y))
    quality.train(docs, labels)
    assert len(seen["x"]) == labels.filter(quality.remainder(F.col("doc_id"), 4) != 2).count()
    quality.train(docs.limit(0), labels)
    assert seen["x"].shape == (0, len(quality.FEATURES))
    toxicity.train(docs.limit(0), labels)
    assert seen["texts"] == []
