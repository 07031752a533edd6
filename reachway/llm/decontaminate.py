"""Benchmark decontamination by greedy string tiling.

Texts become sequences of benchmark vocabulary numbers (0: a word that no benchmark item has). A running Karp-Rabin hash over windows of
MIN_MATCH words finds the seeds that a text shares with benchmark items. For each such pair, seeds on one diagonal are joined to runs, and the
longest run whose words are still free in both sequences is marked again and again, so that tiles never overlap; runs that
earlier tiles cut are split. An item's coverage is the share of its words in tiles: passages in another order count in full.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare, without

TOKEN = re.compile(r"\w+")
MIN_MATCH = 5
#: An item is leaked if tiles cover at least this share of its words.
MIN_COVERAGE = 0.6
#: Benchmark text (characters) that is collected and broadcast at once; a larger benchmark is taken in that many blocks.
BLOCK_CHARS = 16_000_000
CHUNK_CHARS = 2_000_000
#: Pairs of a seed in a text and one in an item that are listed at once.
SEED_BLOCK = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64())])


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """The Karp-Rabin hash (modulo 2**64) of every window of this width."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _BASE + ids[i : i + n]
    return out


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of spans with these starts and lengths."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _blocks(counts: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices whose counts sum up to about limit."""
    if len(counts):
        cuts = np.flatnonzero(np.diff((np.cumsum(counts) - 1) // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)], strict=True):
            yield slice(a, b)


class Benchmark:
    """One block of benchmark items as arrays, with the seeds of all of them sorted by hash. It is built once, on the driver, and broadcast."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        rows = []
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            if len(ids) >= min_match:
                rows.append((item_id, np.array(ids, np.uint64)))
        self.ids = [i for i, _ in rows]
        self.size = np.array([len(x) for _, x in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate([x for _, x in rows]) if rows else np.zeros(0, np.uint64)
        hashes = window_hashes(self.words, min_match)
        item = np.repeat(np.arange(len(rows)), self.size)[: len(hashes)]
        place = np.arange(len(hashes)) - self.start[item] if len(rows) else np.zeros(0, np.int64)
        inside = place + min_match <= self.size[item] if len(rows) else np.zeros(0, bool)
        order = np.lexsort((place[inside], item[inside], hashes[inside]))
        self.item, self.place = item[inside][order].astype(np.int32), place[inside][order].astype(np.int32)
        self.hashes, self.first, self.count = np.unique(hashes[inside][order], return_index=True, return_counts=True)
        self.key = np.repeat(np.arange(len(self.hashes)), self.count) * len(rows) + self.item  # ascending

    def runs(self, item: int, doc: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the item, place in the text and length of all maximal common runs. at, which: the text's seeds (places, and numbers of hashes).
        Seeds are expanded in blocks, and become runs at once: memory is a block and the runs."""
        ids, w = self.words[self.start[item] : self.start[item] + self.size[item]], self.min_match
        wanted = which * len(self.ids) + item
        low = np.searchsorted(self.key, wanted)
        counts = np.searchsorted(self.key, wanted, side="right") - low
        own = counts > 0
        at, low, counts = at[own], low[own], counts[own]
        parts = []
        for s in _blocks(counts, SEED_BLOCK):
            t = np.repeat(at[s], counts[s])
            p = self.place[_expand(low[s], counts[s])].astype(np.int64)
            same = np.ones(len(p), bool)
            for k in range(w):
                same &= ids[p + k] == doc[t + k]
            p, t = p[same], t[same]
            order = np.lexsort((t, t - p))
            parts.append(self._joined((t - p)[order], t[order], t[order]))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        d, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((first, d))
        d, first, last = self._joined(d[order], first[order], last[order])
        return first - d, first, last - first + w

    @staticmethod
    def _joined(d: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs (diagonal, first and last place of a seed), sorted, with those joined that follow one another."""
        if not len(d):
            return d, first, last
        new = np.r_[True, (d[1:] != d[:-1]) | (first[1:] != last[:-1] + 1)]
        ends = np.r_[np.flatnonzero(new)[1:] - 1, len(d) - 1]
        return d[new], first[new], last[ends]

    def tile(self, item: int, doc: np.ndarray, at: np.ndarray, which: np.ndarray) -> float:
        """The share of the item's words in tiles: again and again the longest run that is free in both sequences (then the first in the item, then in the text)."""
        w = self.min_match
        p, t, n = self.runs(item, doc, at, which)
        heap = list(zip((-n).tolist(), p.tolist(), t.tolist(), strict=True))
        heapq.heapify(heap)
        in_item, in_doc = np.zeros(self.size[item], bool), np.zeros(len(doc), bool)
        while heap:
            length, p, t = heapq.heappop(heap)
            free = ~(in_item[p : p - length] | in_doc[t : t - length])
            if free.all():
                in_item[p : p - length] = True
                in_doc[t : t - length] = True
                if in_item.all():
                    break
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= w:
                    heapq.heappush(heap, (a - b, p + a, t + a))
        return float(in_item.mean())

    def leaks(self, texts: list[str | None], min_coverage: float) -> Iterator[tuple[int, int, float]]:
        """(number of the text, item_id, coverage) of every pair at or over min_coverage."""
        get = self.vocabulary.get
        docs = [np.array([get(w, 0) for w in tokens(t)], np.uint64) for t in texts]
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        everything = np.zeros(int(sizes.sum()), np.uint64)
        for s, d in zip(starts, docs, strict=True):
            everything[s : s + len(d)] = d
        h = window_hashes(everything, self.min_match)
        if not len(self.hashes) or not len(h):
            return
        number = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[number] == h)
        number = number[at]
        text = np.searchsorted(starts, at, side="right") - 1
        # tiles lie within the windows of seeds' places in the item, so that these must be enough; a text's seeds count once, whatever their repeats
        pairs = np.unique(text * len(self.hashes) + number)
        k, hashes = pairs // len(self.hashes), pairs % len(self.hashes)
        cut = np.flatnonzero(np.diff(k)) + 1
        for own, seeds in zip(np.split(k, cut), np.split(hashes, cut), strict=True):
            if not len(own):
                continue
            places = np.bincount(self.item[_expand(self.first[seeds], self.count[seeds])], minlength=len(self.ids))
            likely = np.flatnonzero((places > 0) & (places * self.min_match >= min_coverage * self.size))
            if not len(likely):
                continue
            one = int(own[0])
            low, high = np.searchsorted(text, [one, one + 1])
            for item in likely.tolist():
                c = self.tile(item, docs[one], at[low:high] - starts[one], number[low:high])
                if c >= min_coverage:
                    yield one, self.ids[item], c


def find_leaks(shared, min_coverage: float):
    def rows(bench: Benchmark, ids: list, texts: list) -> pa.RecordBatch:
        hits = [(ids[k], i, c) for k, i, c in bench.leaks(texts, min_coverage)]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in hits], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value  # unpickled once by a worker process, whatever the number of its tasks
        ids, texts, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text or "")
                if held >= CHUNK_CHARS:
                    yield rows(bench, ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(bench, ids, texts)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, coverage of every pair of a document and a benchmark item that it leaks.

    The benchmark is the query set: its size is checked first, and it is collected and broadcast in blocks of about block_chars
    characters; every block meets all documents in one narrow pass. Null and empty texts have no words and leak nothing; items of fewer than min_match
    words (or none) can't be leaked: they have no seed, and a word or two prove nothing. Repeated rows give repeated pairs, ties of runs go to the first place in the item. An empty table of documents or
    items gives no pairs; texts and items of any length are matched as a whole; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in part.collect()], min_match))
        hits = slim.mapInArrow(find_leaks(shared, min_coverage), "doc_id long, item_id long, coverage double")
        out = hits if out is None else out.unionByName(hits)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """docs less the documents (by doc_id; a null one is an id like others) that leak an item."""
    return without(docs, leaks(docs, benchmark, min_coverage=min_coverage).select(F.col("doc_id").alias("gone")).distinct())


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items (long), item_ids (array of long, ascending), coverage (double: the highest, 0 without a leak)."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")).withColumnRenamed("doc_id", "leaking")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = out.join(found, out["doc_id"].eqNullSafe(found["leaking"]), "left")
    items = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
