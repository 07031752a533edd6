"""Near-duplicate removal for whole corpora: wide SimHash fingerprints, anchor-point covering, and an exact check.

Texts that are equal word for word are one to begin with. For the rest, candidates come in two ways. A 384-bit SimHash over distinct words (twelve
blocks of 32 bits) is replicated to anchors as in simhash.py: any two fingerprints within 23 bits meet for certain, farther ones with a probability;
what meets within HAMMING bits is linked. Beside it an exact way misses no pair of the wanted similarity: of n shingles in a fixed order, two such
sets share one of their first n - ceil(similarity * n) + 1. Pairs that meet there are left out only where sizes or parity bitmaps prove them too
different. Links make candidate classes; inside classes the shingle sets are compared exactly, and only pairs of the wanted similarity link
documents.

Classes are dealt to chunks of bounded size. Chunks are compared inside first; then one text of each component that this gives with those of the other chunks of its
class. A class that is one component by then, such as a large group of near copies, is done; only the rest is compared as a whole, two chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import BROADCAST_IDS, prepare, without
from reachway.llm.components import components
from reachway.llm.simhash import _BITS, _WORDS, _met, groups, needed, replicate, shingle_hashes, star_links

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint (an even number of blocks), and the bits within which fingerprints are candidates: 22 %.
WIDE = 6
HAMMING = 84
#: Shingles that one chunk of a class holds at most (but for one text that has more): 8 bytes each.
CHUNK_SHINGLES = 2_000_000
#: Texts of one chunk of a class, about; and of one chunk of a class that has to be compared as a whole.
CHUNK_ROWS, WIDE_ROWS = 128, 2_048
#: Least bits of a parity bitmap over shingles (a power of two, over 1.5 bits a shingle): each bit that differs stands for a shingle that only one of two sets has.
BITMAP = 1024
#: Documents whose shingles are counted to find common ones, and the number of these that are put last in the order. Any order is exact; this one keeps groups small.
HEAT_DOCS, HEAT_SHINGLES = 10_000, 32_768
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PARTS = [f"f{i}" for i in range(1, WIDE + 1)]
_PRINT = ", ".join(f"{c} long" for c in ("doc_id", "k1", "k2", "n", *_PARTS))


def keyed(words: list[bytes]) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8")
    return int(d[0]), int(d[1])


def wide_print(words: list[bytes]) -> np.ndarray:
    """WIDE words of 64 bits over the distinct words."""
    own = sorted(set(words))
    if not own:
        return np.zeros(WIDE, np.int64)
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, s) for w in own for s in range(WIDE // 2)), np.uint8).reshape(len(own), 8 * WIDE)
    seen = np.bincount((raw + np.arange(8 * WIDE) * 256).ravel(), minlength=8 * WIDE * 256).reshape(8 * WIDE, 256) @ _BITS
    return np.packbits((2 * seen > len(own)).ravel(), bitorder="little").view("<i8")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())
            rows.append((doc_id, *keyed(words), max(1, len(words) - SHINGLE + 1), *wide_print(words).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * (4 + WIDE))], names=[x.split()[0] for x in _PRINT.split(", ")])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (anchor, id, home) in groups of several with a home."""
    for cols, starts in groups(batches):
        keep = _met(cols, starts)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols[:2]], names=["anchor", "id"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (anchor, id, parts of fingerprints) to links between ids."""
    for cols, starts in groups(batches):
        f = np.stack(cols[2:], 1).view(np.uint64)
        a, b = star_links(f, starts, HAMMING)
        use = needed(cols[0], f, a, b, HAMMING)
        yield pa.RecordBatch.from_arrays([pa.array(cols[1][x[use]]) for x in (a, b)], schema=_EDGES)


def _hashes(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(text).view(np.int64))], names=["h"])


def bitmap(hashes: np.ndarray) -> bytes:
    width = max(BITMAP, 1 << (3 * len(hashes) // 2).bit_length())
    return np.packbits(np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they are with so many words."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _same_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (token, id) in groups of several, named by their ids: groups of the same ids become one."""
    for cols, starts in groups(batches):
        x = cols[1].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        sizes = np.diff(np.r_[starts, len(x)])
        name = np.repeat(np.add.reduceat(x ^ (x >> np.uint64(31)), starts), sizes).view(np.int64)
        keep = np.repeat(sizes > 1, sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(cols[1][keep])], names=["anchor", "id"])


def _prefixes(similarity: float, common: np.ndarray, counts: np.ndarray):
    """Rows (id, text) to (id, k1, k2, size, bits, tokens): the first shingles by count in the sample, then by hash. common: sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = _hashes(text)
                if not len(h):
                    continue
                heat = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    heat = np.where(common[at] == h, counts[at], 0)
                first = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                tokens = h[np.lexsort((h, heat))[:first]].view(np.int64)
                rows.append((doc_id, *keyed(_WORDS.findall(text.encode("utf-8", "replace").lower())), len(h), bitmap(h), tokens))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "k1", "k2", "size", "bits", "tokens"])

    return run


def token_links(size: np.ndarray, bits: list[bytes], starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links as row numbers within groups that start at these rows, between sets that sizes and bitmaps allow to be similar."""
    allowed = (1 - similarity) / (1 + similarity)
    words = np.array([len(x) // 8 for x in bits])
    maps, at = {}, np.zeros(len(bits), np.int64)
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        maps[w], at[rows] = np.frombuffer(b"".join([bits[r] for r in rows]), np.uint64).reshape(len(rows), w), np.arange(len(rows))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
        for u, v in {*zip(words[i[out]].tolist(), words[j[out]].tolist(), strict=True)}:
            own = np.flatnonzero(out & (words[i] == u) & (words[j] == v))
            x, y = (_folded(maps[w][at[k[own]]], min(u, v)) for w, k in ((u, i), (v, j)))
            out[own] = np.bitwise_count(x ^ y).sum(1) <= allowed * (size[i[own]] + size[j[own]]) + 1e-6
        return out

    ends = np.r_[starts[1:], len(size)]
    pairs = starts[ends - starts == 2]
    pairs = pairs[near(pairs, pairs + 1)]
    a, b = [pairs], [pairs + 1]
    for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
        left = np.arange(s, e)
        while len(left):
            first, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                hit = near(left, np.full(len(left), queue.pop()))
                if hit.any():
                    a.append(np.full(int(hit.sum()), first))
                    b.append(left[hit])
                    queue.extend(left[hit])
                    left = left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _token_candidates(similarity: float):
    """Sorted rows (anchor, id, size, bits) to links between ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in groups(batches):
            a, b = token_links(cols[2], cols[3].tolist(), starts, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][x]) for x in (a, b)], schema=_EDGES)

    return run


def prefix_pairs(slim: DataFrame, one: DataFrame, similarity: float) -> DataFrame:
    """a, b (long): links that hold every pair of the wanted similarity in a chain. one: the first row of equal texts (id, k1, k2)."""
    n = slim.count()
    some = slim.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, HEAT_DOCS / max(n, 1)) * (1 << 20))))
    heat = some.select("text").mapInArrow(_all_shingles, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(HEAT_SHINGLES).collect()
    common, counts = np.array([r[0] for r in heat], np.int64).view(np.uint64), np.array([r[1] for r in heat], np.int64)
    order = np.argsort(common)
    found = slim.select("doc_id", "text").mapInArrow(_prefixes(similarity, common[order], counts[order]), "id long, k1 long, k2 long, size long, bits binary, tokens array<long>")
    found = found.join(one.select("id", "k1", "k2"), ["id", "k1", "k2"]).checkpoint()
    dealt = found.select(F.explode("tokens").alias("anchor"), "id").repartition("anchor").sortWithinPartitions("anchor", "id")
    met = dealt.mapInArrow(_same_once, "anchor long, id long").distinct().checkpoint()
    known = met.join(found.select("id", "size", "bits"), "id").select("anchor", "id", "size", "bits")
    return known.repartition("anchor").sortWithinPartitions("anchor", "id").mapInArrow(_token_candidates(similarity), "a long, b long")


def similar(sets: list[np.ndarray], similarity: float) -> list[list[int]]:
    """Components of sorted sets that are linked by a Jaccard similarity of at least this. A set is compared with those not yet reached."""
    sizes = np.array([len(s) for s in sets], np.int64)
    left, out = np.arange(len(sets)), []
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    base = np.cumsum(sizes) - sizes
    held, rows = flat, left  # the sets not yet reached at the last gathering

    while len(left):
        queue, own, left = [int(left[0])], [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            if 2 * len(left) < len(rows):
                rows = left
                held = np.concatenate([flat[base[r] : base[r] + sizes[r]] for r in rows])
            one = flat[base[p] : base[p] + sizes[p]]
            at = np.minimum(np.searchsorted(one, held), len(one) - 1)
            both = np.add.reduceat((one[at] == held).astype(np.int64), np.cumsum(sizes[rows]) - sizes[rows])
            near = rows[both >= similarity * (sizes[rows] + sizes[p] - both) - 1e-9]
            near = near[np.isin(near, left, assume_unique=True)]
            if len(near):
                own.extend(near.tolist())
                queue.extend(near.tolist())
                left = left[~np.isin(left, near, assume_unique=True)]
        out.append(own)
    return out


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, k1, k2, label, cells, text) to (id, label, cells, shingles), where the text has that key."""
    for b in batches:
        ids, k1, k2, labels, cells, texts = (c.to_pylist() for c in b.columns)
        for i in range(0, len(ids), 64):
            rows = []
            for doc_id, x, y, label, own, t in zip(*(c[i : i + 64] for c in (ids, k1, k2, labels, cells, texts)), strict=True):
                if keyed(_WORDS.findall((t or "").encode("utf-8", "replace").lower())) == (x, y):
                    rows.append((doc_id, label, own, np.unique(np.array(shingle_hashes(t, SHINGLE), np.uint64)).view(np.int64)))
            types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["id", "label", "cells", "shingles"])


def _verify(similarity: float):
    """Sorted rows (cell, id, label, shingles) to links between ids of the wanted similarity, within cells of several labels."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = [], []
        for own in similar(sets, similarity):
            a += [ids[i] for i in own[1:]]
            b += [ids[own[0]]] * (len(own) - 1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], schema=_EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, labels, sets = None, [], set(), []
        for b in batches:
            for c, i, label, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if c != cell:
                    if len(labels) > 1:
                        yield links(ids, sets)
                    cell, ids, labels, sets = c, [], set(), []
                values = np.sort(s.values.to_numpy().view(np.uint64))
                if len(values):
                    ids.append(i)
                    labels.add(label)
                    sets.append(values)
        if len(labels) > 1:
            yield links(ids, sets)

    return run


def _paired(rows: DataFrame, chunk_rows: int, chunk_shingles: int) -> DataFrame:
    """rows (id, root, k1, k2, n, label) of classes with cells: each row's chunk of its class with every chunk, itself alone where there is one only."""
    size = rows.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(chunk_rows)), F.ceil(F.sum("n") / F.lit(chunk_shingles))).cast("int").alias("chunks"))
    dealt = rows.join(size, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: (k != F.col("own")) | (F.col("chunks") == 1))
    cells = F.transform(others, lambda k: F.concat_ws(":", F.col("root"), F.least("own", k), F.greatest("own", k)))
    return dealt.select("id", "k1", "k2", "label", cells.alias("cells"))


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY, chunk_shingles: int = CHUNK_SHINGLES, broadcast_ids: int = BROADCAST_IDS, chunk_rows: int = CHUNK_ROWS, wide_rows: int = WIDE_ROWS) -> DataFrame:
    """doc_id, group_id (long) for every row with an id: group_id is the least doc_id that links lead to.

    Links join texts that are equal word for word (A-Z lower-cased, white space aside; texts without words are equal) and candidates whose sets of five-word
    shingles have a Jaccard similarity of at least `similarity`. Rows with one doc_id count as one document. Null and empty texts have no words. An empty table gives an empty table; texts of any length are shingled as a whole; other columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    # candidate ids, and cells, up to broadcast_ids (some 64 bytes each) are broadcast to find their texts; more are joined by a shuffle
    prints = slim.mapInArrow(_prints, _PRINT).checkpoint()
    one = prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", *_PARTS)]).checkpoint()
    dealt = one.select("id", *_PARTS).mapInArrow(replicate(WIDE), "anchor long, id long, home boolean").repartition("anchor").sortWithinPartitions("anchor", "id")
    met = dealt.mapInArrow(_prune, "anchor long, id long").checkpoint()
    known = met.join(one.select("id", *_PARTS), "id").select("anchor", "id", *_PARTS)
    pairs = known.repartition("anchor").sortWithinPartitions("anchor", "id").mapInArrow(_candidates, "a long, b long")
    classes = components(pairs.unionByName(prefix_pairs(slim, one, similarity)).distinct())
    found = classes.join(one.select("id", "k1", "k2", "n"), F.col("node") == F.col("id")).select("id", "root", "k1", "k2", "n")
    size = F.greatest(F.ceil(F.sum("n") / F.lit(chunk_shingles)), F.ceil(F.count("*") / F.lit(chunk_rows)))
    chunks = found.groupBy("root").agg(size.cast("int").alias("chunks"))
    found = found.join(chunks, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).checkpoint()

    def verified(rows: DataFrame) -> DataFrame:
        """a, b: each text (id) with the first of its component, in every cell of several labels. rows: id, k1, k2, label, cells; shingles are shuffled once."""
        size = rows.agg(F.count("*"), F.sum(F.size("cells"))).first()
        wanted = F.broadcast(rows) if size[0] <= broadcast_ids and (size[1] or 0) <= broadcast_ids else rows
        sets = slim.withColumnRenamed("doc_id", "id").join(wanted, "id").select("id", "k1", "k2", "label", "cells", "text").mapInArrow(_shingled, "id long, label long, cells array<string>, shingles array<long>")
        dealt = sets.select(F.explode("cells").alias("cell"), "id", "label", "shingles").repartition("cell").sortWithinPartitions("cell", "id")
        return dealt.mapInArrow(_verify(similarity), "a long, b long").checkpoint()

    # every text is in one chunk: what is linked there is a star around its least id
    stars = verified(found.select("id", "k1", "k2", F.col("id").alias("label"), F.array(F.concat_ws(":", "root", "own")).alias("cells")))
    near = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = found.filter("chunks > 1").drop("own", "chunks")
    if not large.isEmpty():
        labelled = large.join(stars.select(F.col("a").alias("id"), F.col("b").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
        first = labelled.filter("label = id")
        links = verified(_paired(first, chunk_rows, chunk_shingles))
        one_cell = first.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter((F.col("c") > chunk_rows) | (F.col("n") > chunk_shingles)).isEmpty()
        joined = links.select(F.col("a").alias("first"), F.col("b").alias("least")) if one_cell else components(links).select(F.col("node").alias("first"), F.col("root").alias("least"))
        named = labelled.join(joined, F.col("label") == F.col("first"), "left").withColumn("label", F.coalesce("least", "label")).drop("first", "least").checkpoint()
        open_classes = named.groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("root")
        left = named.join(open_classes, "root", "left_semi")
        if left.isEmpty():
            near = near.join(joined, F.col("root") == F.col("first"), "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(joined.filter("first <> least").select(F.col("first").alias("node"), F.col("least").alias("root")))
        else:
            near = components(stars.unionByName(links).unionByName(verified(_paired(left, wide_rows, chunk_shingles))))
    # copies follow their first one
    named = one.select("k1", "k2", "id").join(near, F.col("id") == F.col("node"), "left").select("k1", "k2", F.coalesce("root", "id").alias("group_id"))
    return prints.join(named, ["k1", "k2"]).select("doc_id", "group_id")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs less all documents of a group but the one of least doc_id. Rows without an id stay; rows that share an id stay or go together."""
    return without(docs, near_duplicate_groups(docs, similarity).filter("doc_id <> group_id").select(F.col("doc_id").alias("gone")).distinct())
