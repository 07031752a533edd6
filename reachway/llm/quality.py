"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown in numpy on the driver from a bounded sample of labelled rows, level by level from histograms of binned statistics, and
flattened into arrays (feature, threshold, leaf value by tree and node); scoring walks all trees for a batch of documents at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import WORD, prepare, replaced

#: Labelled rows that a model is fitted on at most, by the least hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, PENALTY = 80, 4, 64, 0.15, 5.0, 1.0
CUT = 0.7
FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "upper", "digit", "symbol", "punctuation", "space", "pipe", "high_bytes", "log_lines", "words_a_line", "duplicate_lines", "ended_lines",
    "distinct_words", "top_word", "top_five_words", "same_as_last", "one_char_words", "with_symbol", "shouted", "capital_start", "byte_entropy",
)
_UPPER, _DIGIT, _PUNCT, _SYMBOL, _SPACE = (np.array([x in s for x in range(256)]) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>=+@~^_{}[]\\/`", b" \t\n\x0b\x0c\r"))


def statistics(text: str | None) -> list[float]:
    """The statistics of FEATURES; zeros for a text without characters."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = raw.sum()
    words = WORD.findall(text)
    n = len(words)
    lines = text.split("\n")
    full = [x for x in lines if x and not x.isspace()]
    counts = Counter(words)
    top = counts.most_common(5)
    lengths = list(map(len, words))
    shares = raw[raw > 0] / size
    many, k = max(1, n), max(1, len(full))
    return [
        np.log1p(len(text)), np.log1p(n), sum(lengths) / many, max(lengths, default=0), raw[_UPPER].sum() / size, raw[_DIGIT].sum() / size, raw[_SYMBOL].sum() / size, raw[_PUNCT].sum() / size, raw[_SPACE].sum() / size,
        raw[124] / size, raw[128:].sum() / size, np.log1p(len(lines)), n / k, 1 - len(set(full)) / k, sum(x.rstrip()[-1] in ".!?" for x in full) / k,
        len(counts) / many, top[0][1] / many if top else 0.0, sum(c for _, c in top) / many, sum(map(str.__eq__, words, words[1:])) / many, lengths.count(1) / many,
        sum(not x[-1].isalnum() and x[-1] not in ".,;:!?'\")" for x in words) / many, sum(map(str.isupper, words)) / many, sum(x[0].isupper() for x in words) / many, float(-(shares * np.log2(shares)).sum()),
    ]


@dataclass
class Trees:
    """All trees as arrays by tree and node: nodes are numbered as in a heap, leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        n, trees = len(x), np.arange(len(self.feature))
        node = np.zeros((n, len(trees)), np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(trees) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + (self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(trees) else np.zeros(n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosted trees for the logistic loss. Without rows, or with one label only, the model is a constant."""
    inner, share = (1 << depth) - 1, (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin > b  <=>  value > edges[b]
    flat = binned + np.arange(x.shape[1]) * bins
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (x.shape[1] * bins) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, x.shape[1]), wide * x.shape[1] * bins).reshape(wide, x.shape[1], bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :1, -1:] for s in sums)
            gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(wide, -1).max(1) > 1e-9):
                f, b = divmod(int(best[k]), bins)
                feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        gs, hs = (np.bincount(node - inner, v, inner + 1) for v in (g, h))
        leaf[t] = -RATE * gs / (hs + PENALTY)
        total += leaf[t, node - inner]
    return Trees(feature, threshold, leaf, base)


_FLOATS = pa.list_(pa.float64())


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([list(map(float, statistics(t))) for t in b.column(2).to_pylist()], _FLOATS)], names=["doc_id", "y", "x"])


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int, balanced: bool = False) -> DataFrame:
    """doc_id, y and text of at most this many labelled ids outside the held-out part: those with the least hashes; balanced: half the ids for each label at most. An id that
    several rows of docs have comes with each of them."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), parts) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    pick = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(known.filter("y > 0"), rows // 2).unionByName(pick(known.filter("y <= 0"), rows // 2)) if balanced else pick(known, rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "y", F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, rows: int = SAMPLE_ROWS) -> Trees:
    """A model from labelled documents whose crc32 remainder isn't the held-out one: at most `rows` ids, one row of each (the least statistics), so that what reaches the driver is bounded. Null and
    empty texts have statistics that are all zero; texts of any length are measured as a whole. Without labelled documents the model is a constant of one half."""
    prepare(docs.sparkSession)
    every = labelled(docs, labels, label, parts, held, rows).mapInArrow(measured, "doc_id string, y double, x array<double>")
    sample = every.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("one")).select("one.y", "one.x").toPandas()
    x = np.array(sample["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = sample["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums shall not depend on it
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Trees, cut: float = CUT) -> DataFrame:
    """docs with score (double) and predicted (int: 1 at cut or more). Every row is scored by itself; null and empty texts get the score of statistics that are all zero; texts of any length are measured as a whole; repeated rows
    get equal scores, an empty table gives an empty table, a score of exactly `cut` is a 1. Input columns of these names are replaced."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(np.concatenate([shared.value.score(x[i : i + 2048]) for i in range(0, max(1, len(x)), 2048)]))

    out = replaced(docs, score=F.pandas_udf(score, "double")(F.col("text").cast("string")))
    return replaced(out, predicted=(F.col("score") >= cut).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
