"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the sum of embeddings of its hash, its first letters and its letter trigrams. Windows of WINDOW words, each STRIDE words after
the last, are read in both directions; attention pools the states to one logit a window. A document's logit is its largest window's; a
logistic calibration, fitted with the network, makes it a probability.

Training is multiple-instance: only documents have labels, so that windows are chosen by a naive Bayes weight at first, then by the
network itself, and the network is fitted to them by Adam.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare, replaced
from reachway.llm.quality import labelled, remainder

#: Labelled documents that a model is fitted on at most, and the characters that these have together at most: half for each label, by the least hash of their id. A document that would
#: exceed what is left of the characters is passed over, so that long documents serve like short ones.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 24_000_000
WINDOW, STRIDE = 32, 16
BUCKETS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 16, 8, 8
EPOCHS, ROUNDS, BATCH, RATE = 3, 3, 256, 0.01
#: Windows of a document that a round trains on at most: the highest, by label.
TOP_WINDOWS = {1: 2, 0: 2}
CUT = 0.7
#: Words whose inputs a worker keeps before it starts anew.
CACHE_WORDS = 200_000
#: Words that are embedded at once.
CHUNK_WORDS = 20_000
#: Windows that are scored at once.
CHUNK_WINDOWS = 4_096
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Lengths of the first letters that are features.
PREFIXES = (3, 4, 5, 6)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(40)) % np.uint64(BUCKETS)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and where each word's start: its hash, its first letters, its trigrams (with marks at both ends)."""
    n = len(words)
    if n > CHUNK_WORDS:
        parts = [word_features(words[i : i + CHUNK_WORDS]) for i in range(0, n, CHUNK_WORDS)]
        sizes = np.concatenate([np.diff(starts) for _, starts in parts])
        return np.concatenate([f for f, _ in parts]), np.r_[0, np.cumsum(sizes)]
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(n), sizes)
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * (np.arange(len(codes)) - starts[word] + 1).astype(np.uint64) * _MIX ^ codes * codes, out=run[1:])
    whole = run[starts + sizes] - run[starts]
    which, feats = [np.arange(n)], [_bucket(whole, 1)]
    for k in PREFIXES:
        has = np.flatnonzero(sizes - 2 >= k)
        h = np.zeros(len(has), np.uint64)
        for i in range(k):
            h = h * _MIX + codes[starts[has] + 1 + i]
        which.append(has)
        feats.append(_bucket(h, k + 10))
    inside = np.flatnonzero(np.arange(len(codes)) - starts[word] <= sizes[word] - 3)
    h = (codes[inside] * _MIX + codes[inside + 1]) * _MIX + codes[inside + 2]
    which.append(word[inside])
    feats.append(_bucket(h, 2))
    which, feats = np.concatenate(which), np.concatenate(feats).astype(np.int64)
    order = np.argsort(which, kind="stable")
    return feats[order].astype(np.int32), np.searchsorted(which[order], np.arange(n + 1))


def windows(sizes: np.ndarray, offset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of all windows over documents of these numbers of words, which lie one after another."""
    count = np.where(sizes <= WINDOW, (sizes > 0).astype(np.int64), -(-(sizes - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(sizes) - sizes
    start = nth * STRIDE
    return base[doc] + start + offset, np.minimum(WINDOW, sizes[doc] - start), doc


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of spans with these starts and lengths."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights by name, and the calibration of a document's largest logit. forward/backward directions have their own w, u and b."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    empty: float = -3.0
    seen: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    @staticmethod
    def new(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        shapes = {"e": (BUCKETS, WIDTH), "wf": (WIDTH, 3 * HIDDEN), "wb": (WIDTH, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "bf": (3 * HIDDEN,), "bb": (3 * HIDDEN,), "a": (2 * HIDDEN, ATTENTION), "v": (ATTENTION,), "o": (2 * HIDDEN,), "c": (1,)}
        return Network({k: (r.normal(0, 0.1 if k == "e" else 1 / np.sqrt(s[0]), s) if k[0] not in "bc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})

    def embed(self, words: list[str]) -> np.ndarray:
        feats, starts = word_features(words)
        return np.add.reduceat(self.p["e"][feats], starts[:-1], axis=0) / np.sqrt(np.diff(starts))[:, None].astype(np.float32)

    def run(self, x: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. x: gate inputs by direction (step, window, 3 * HIDDEN); mask: (step, window, 1)."""
        p, n, saved = self.p, mask.shape[1], {}
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        for d, at in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h, steps = np.zeros((n, HIDDEN), np.float32), []
            for t in at:
                g = h @ p["u" + d]
                zr = _sigmoid(x[d][t][:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[d][t][:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = h + mask[t] * ((1 - z) * (c - h))
                if keep:
                    steps.append((t, h, z, r, c, g[:, 2 * HIDDEN :]))
                h = new
                states[t, :, slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)] = h
            saved[d] = steps
        q = np.tanh(states @ p["a"])
        s = q @ p["v"] + (mask[:, :, 0] - 1) * 30
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        return pooled @ p["o"] + p["c"][0], saved | {"states": states, "q": q, "w": w, "pooled": pooled}

    def gradients(self, mask: np.ndarray, s: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the weights and of the gate inputs."""
        p, g = self.p, {}
        g["o"], g["c"] = s["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["o"]
        dw = (s["states"] * dpooled).sum(2)
        ds = s["w"] * (dw - (s["w"] * dw).sum(0))
        dq = ds[:, :, None] * p["v"] * (1 - s["q"] ** 2)
        g["v"] = np.einsum("tn,tna->a", ds, s["q"])
        g["a"] = np.einsum("tnh,tna->ha", s["states"], dq)
        dstates = s["w"][:, :, None] * dpooled + dq @ p["a"].T
        dx = {}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p["u" + d]
            du, dh = np.zeros_like(u), np.zeros_like(dstates[0][:, :HIDDEN])
            dx[d] = np.empty((*mask.shape[:2], 3 * HIDDEN), np.float32)
            for t, h, z, r, c, gn in reversed(s[d]):
                dh = dh + dstates[t][:, part]
                dm = dh * mask[t]
                dc = dm * (1 - z) * (1 - c * c)
                dz = dm * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], 1)
                dx[d][t] = np.concatenate([dz, dr, dc], 1)
                du += h.T @ dg
                dh = dh - dm * (1 - z) + dg @ u.T
            g["u" + d] = du
        return g, dx

    def rows(self, words: list[str]) -> np.ndarray:
        """Table rows of words; gate inputs of new ones are added. Row 0 is padding."""
        if self.table is None or len(self.seen) > CACHE_WORDS:
            self.seen, self.table = {}, np.zeros((1, 6 * HIDDEN), np.float32)
        fresh = list({w for w in words if w not in self.seen})
        if fresh:
            start = len(self.seen) + 1
            self.seen.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            if start + len(fresh) > len(self.table):
                grown = np.zeros((max(start + len(fresh), min(2 * len(self.table), CACHE_WORDS)), 6 * HIDDEN), np.float32)
                grown[:start] = self.table[:start]
                self.table = grown
            for i in range(0, len(fresh), CHUNK_WORDS):
                e = self.embed(fresh[i : i + CHUNK_WORDS])
                for d, at in (("f", 0), ("b", 3 * HIDDEN)):
                    self.table[start + i : start + i + len(e), at : at + 3 * HIDDEN] = e @ self.p["w" + d] + self.p["b" + d]
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def logits(self, rows: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of windows over table rows."""
        out = np.empty(len(start), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for i in range(0, len(start), CHUNK_WINDOWS):
            s, n = start[i : i + CHUNK_WINDOWS], length[i : i + CHUNK_WINDOWS]
            mask = steps < n
            x = self.table[np.where(mask, rows[np.minimum(s + steps, len(rows) - 1)], 0)]
            out[i : i + CHUNK_WINDOWS] = self.run({"f": x[:, :, : 3 * HIDDEN], "b": x[:, :, 3 * HIDDEN :]}, mask[:, :, None].astype(np.float32))[0]
        return out

    def best(self, texts: list[list[str]]) -> np.ndarray:
        """The largest window logit of each document; that of an empty one is `empty`."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.full(len(texts), -np.inf)
        if sizes.sum():
            rows = self.rows([w for t in texts for w in t])
            start, length, doc = windows(sizes)
            np.maximum.at(out, doc, self.logits(rows, start, length))
        return np.where(np.isinf(out), self.empty, out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(np.clip(self.scale * self.best([tokens(t) for t in texts]) + self.shift, -30, 30))


def fit(texts: list[str | None], y: np.ndarray, share: float | None = None, seed: int = 7) -> Network:
    """A network from documents and labels; share: of label 1 among all documents, where these are a sample by label. Without rows, or with one label only, its score is a constant."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)], np.int32) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    own = (y.sum() + 1) / (len(y) + 2)
    share = own if share is None else share
    if not len(y) or y.min() == y.max() or not sizes.sum():
        net.scale, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    ids = np.concatenate(docs)
    feats, starts = word_features(list(vocabulary))
    root = np.sqrt(np.diff(starts))[:, None].astype(np.float32)
    start, length, doc = windows(sizes)
    # naive Bayes weights of features, by documents that have them
    counts, ends = np.diff(starts), np.cumsum(sizes)
    n1, n0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k in range(len(docs)):
        word = np.unique(ids[ends[k] - sizes[k] : ends[k]])
        own_feats = np.unique(feats[_spans(starts[word], counts[word])])
        (n1 if y[k] == 1 else n0)[own_feats] += 1
    r1, r0 = (n1 + 0.5) / (y.sum() + 1), (n0 + 0.5) / (len(y) - y.sum() + 1)
    weight = np.log(r1 / r0) * np.minimum(1, n1 / 5)
    by_word = np.maximum.reduceat(weight[feats], starts[:-1])
    steps = np.arange(WINDOW)
    inside = steps < length[:, None]
    value = np.where(inside, by_word[ids[np.minimum(start[:, None] + steps, len(ids) - 1)]], -9).max(1)
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    tick = 0
    for turn in range(ROUNDS):
        if turn:
            net.seen, net.table = {}, None
            value = net.logits(net.rows(list(vocabulary))[ids], start, length)
        order = np.lexsort((-value, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        label = y[doc[order]]
        first = value[order[np.searchsorted(doc[order], doc[order])]]
        near = value[order] >= first - 1.0  # further windows of a toxic document count only if they come near its highest
        use = np.where(label == 1, (rank < TOP_WINDOWS[1]) & ((rank == 0) | near), rank < TOP_WINDOWS[0])
        spare = (label == 0) & ~use & (rng.random(len(order)) < 2 * len(docs) / len(order))
        chosen = order[use | spare]
        target = y[doc[chosen]].astype(np.float32)
        heavy = np.where(target == 1, min(10.0, (target == 0).sum() / max(1, target.sum())), 1).astype(np.float32)
        for _ in range(EPOCHS):
            mix = rng.permutation(len(chosen))
            for i in range(0, len(mix), BATCH):
                m = mix[i : i + BATCH]
                s, n = start[chosen[m]], length[chosen[m]]
                mask = steps[:, None] < n
                used, back = np.unique(ids[np.minimum(s + steps[:, None], len(ids) - 1)], return_inverse=True)
                back = back.reshape(mask.shape)
                cnt = counts[used]
                fa = feats[_spans(starts[used], cnt)]
                first_of = np.cumsum(cnt) - cnt
                e = np.add.reduceat(net.p["e"][fa], first_of, axis=0) / root[used]
                live = mask[:, :, None].astype(np.float32)
                x = {d: (e @ net.p["w" + d] + net.p["b" + d])[back] * live for d in "fb"}
                logit, saved = net.run(x, live, keep=True)
                g, dx = net.gradients(live, saved, ((_sigmoid(logit) - target[m]) * heavy[m] / heavy[m].sum()).astype(np.float32))
                de = np.zeros_like(e)
                for d in "fb":
                    flat = (dx[d] * live).reshape(-1, 3 * HIDDEN)
                    by = np.stack([np.bincount(back.ravel(), flat[:, k], len(used)) for k in range(3 * HIDDEN)], 1).astype(np.float32)
                    g["w" + d], g["b" + d] = e.T @ by, by.sum(0)
                    de += by @ net.p["w" + d].T
                de /= root[used]
                spread = np.repeat(np.arange(len(used)), cnt)
                hit, where = np.unique(fa, return_inverse=True)
                ge = np.stack([np.bincount(where, de[spread, k], len(hit)) for k in range(WIDTH)], 1).astype(np.float32)
                tick += 1
                fix = np.sqrt(1 - 0.999**tick) / (1 - 0.9**tick)
                for k, v in net.p.items():
                    rows, d = (hit, ge) if k == "e" else (slice(None), g[k])
                    m1, m2 = adam[k]
                    m1[rows] = 0.9 * m1[rows] + 0.1 * d
                    m2[rows] = 0.999 * m2[rows] + 0.001 * d * d
                    v[rows] -= RATE * fix * m1[rows] / (np.sqrt(m2[rows]) + 1e-8)
    net.seen, net.table = {}, None
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, doc, net.logits(net.rows(list(vocabulary))[ids], start, length))
    net.seen, net.table = {}, None
    net.empty = float(np.median(top[(y == 0) & np.isfinite(top)])) if ((y == 0) & np.isfinite(top)).any() else 0.0
    top = np.where(np.isfinite(top), top, net.empty)
    # calibration by Newton's method, with a small penalty; rows weigh as much as those that they stand for
    each = np.where(y == 1, share / own, (1 - share) / (1 - own))
    a, b, t = 1.0, 0.0, np.clip(top, -30, 30)
    for _ in range(50):
        q = _sigmoid(np.clip(a * t + b, -30, 30))
        grad = np.array([(each * (q - y) * t).sum() + 0.1 * (a - 1), (each * (q - y)).sum()])
        w = np.maximum(each * q * (1 - q), 1e-6)
        step = np.linalg.solve([[(w * t * t).sum() + 0.1, (w * t).sum()], [(w * t).sum(), w.sum() + 1e-3]], grad)
        step *= min(1.0, 1 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    net.scale, net.shift = float(a), float(b)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    """A network from labelled documents whose crc32 remainder isn't the held-out one: at most `rows` ids, one text of each (the least), and `chars` characters. Null and empty texts count as labelled
    documents without windows."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), parts) != held)).agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    every = labelled(docs, labels, label, parts, held, rows, balanced=True).select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    texts = every.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).checkpoint()
    sizes = texts.select("doc_id", "y", F.length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, room = [], {True: chars // 2, False: chars // 2}
    for doc_id, y, size in sizes:
        if size <= room[y > 0]:
            room[y > 0] -= size
            chosen.append((doc_id,))
    fits = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id string"))
    sample = texts.join(fits, "doc_id").toPandas().sort_values(["text", "y"], kind="stable")
    return fit(sample["text"].tolist(), sample["y"].to_numpy(np.float64), ((known[1] or 0) + 1) / (known[0] + 2))


def scored(docs: DataFrame, model: Network, cut: float = CUT) -> DataFrame:
    """docs with score (double) and predicted (int: 1 at cut or more), every window of every text scored, whatever its length. Null and empty texts get the score of
    a usual clean document; repeated rows get equal scores, of equal windows any is the largest, an empty table gives an empty table. Input columns of these names are replaced."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        import pandas as pd

        out, part, held = [], [], 0
        for t in texts:
            part.append(t)
            held += len(t or "")
            if held > 400_000:
                out.append(shared.value.score(part))
                part, held = [], 0
        if part or not out:
            out.append(shared.value.score(part))
        return pd.Series(np.concatenate(out))

    out = replaced(docs, score=F.pandas_udf(score, "double")(F.col("text").cast("string")))
    return replaced(out, predicted=(F.col("score") >= cut).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
