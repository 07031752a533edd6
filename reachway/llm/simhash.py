"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks of 32 bits; two fingerprints within threshold bits differ in at most ALLOWED = 1 bit in one block at least. The anchors
of a block are the words of a covering code: the perfect Hamming code of length 31, with one free bit (covering radius 1, 2**27 anchors). Every
fingerprint is replicated to all anchors within covering radius plus allowed bits, 2: 16.5 on average. The anchor nearest to one
fingerprint (its home, within the covering radius) is then within reach of any other that differs in one bit, so that linked
fingerprints meet there; fingerprints are compared anchor by anchor, and links go to a connected-components step.

An anchor that very many different fingerprints share is split: fingerprints within three bits of each other have one of the four bytes of the other block in common, so
that they are dealt anew by anchor and each of these bytes. No group is compared, or held, beyond LARGE_GROUP rows before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare
from reachway.llm.components import components

THRESHOLD = 3
SEED = 42
_WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")
#: Groups of at most this many fingerprints are compared pair by pair; larger ones by growing components.
SMALL_GROUP = 8
#: Rows of an anchor beyond which its group is dealt anew by the bytes of the other block.
LARGE_GROUP = 20_000
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of so many words, repeats included; of the whole sequence if there are fewer words."""
    words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower() is ASCII only
    if not words:
        return []
    joined, size = b" ".join(words), min(size, len(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], seed) for a, b in zip([0, *(e + 1 for e in ends)], ends[size - 1 :], strict=False)]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = np.arange(8) * 256


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are those set in over half the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    seen = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(n, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS * 2 > n).ravel(), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int) -> int:
    return majority(np.array(shingle_hashes(text, size), np.uint64))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, f (the fingerprint as a signed long) of every row; 0 for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [signed(fingerprint(t, size)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64())], schema=schema)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, f long")


_SYNDROME = np.zeros((4, 256), np.uint32)
for _byte in range(4):
    for _bit in range(8):
        if (_position := 8 * _byte + _bit + 1) < 32:  # the last bit is free
            _SYNDROME[_byte] ^= np.where(np.arange(256) >> _bit & 1, np.uint32(_position), np.uint32(0))
_FLIP = np.array([0] + [1 << (i - 1) for i in range(1, 32)], np.uint32)
#: By syndrome: the pairs of bits whose change leads to a code word.
_PAIRS = np.array([[0] * 15] + [[int(_FLIP[i] | _FLIP[i ^ s]) for i in range(1, 32) if i != s and i < i ^ s] for s in range(1, 32)], np.uint32)
_FREE = np.uint32(1 << 31)


def nearest_anchor(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home of 32-bit blocks, and their syndromes (0: the block is its own home)."""
    raw = np.ascontiguousarray(block, "<u4").view(np.uint8).reshape(-1, 4)
    s = _SYNDROME[0][raw[:, 0]] ^ _SYNDROME[1][raw[:, 1]] ^ _SYNDROME[2][raw[:, 2]] ^ _SYNDROME[3][raw[:, 3]]
    return block ^ _FLIP[s], s


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, anchor, home) of 32-bit blocks: anchors within two bits; home marks the nearest one."""
    near, s = nearest_anchor(block)
    rows = np.arange(len(block))
    off = np.flatnonzero(s)
    far = (block[off, None] ^ _PAIRS[s[off]]).ravel()
    return (
        np.concatenate([rows, rows, np.repeat(off, 15)]),
        np.concatenate([near, near ^ _FREE, far]),
        np.concatenate([np.ones(len(rows), bool), np.zeros(len(rows) + len(far), bool)]),
    )


def replicate(words: int) -> Callable:
    """Rows (id, f1 .. f<words>) to (anchor, id, home) for every anchor of every block."""
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in range(words):
                f = b.column(1 + w).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for half in (0, 1):
                    row, anchor, home = anchors((f >> np.uint64(32 * half)).astype(np.uint32))
                    key = anchor.astype(np.int64) + ((2 * w + half) << 32)
                    for i in range(0, len(row), 1 << 17):
                        s = slice(i, i + (1 << 17))
                        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(ids[row[s]]), pa.array(home[s])], schema=schema)

    return run


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole groups (equal first column, in sorted batches), and where each group starts; an unfinished group waits for the next batch."""
    wait: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if wait is not None:
            cols = [np.concatenate(x) for x in zip(wait, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        wait = [c[cut:] for c in cols]
        if cut:
            key = cols[0][:cut]
            yield [c[:cut] for c in cols], np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    if wait is not None and len(wait[0]):
        yield wait, np.zeros(1, np.int64)


def grown(f: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Components (arrays of row numbers) of fingerprints f (rows of words) that are linked within threshold bits. A row is compared with those not yet reached."""
    left, out = np.arange(len(f)), []
    while len(left):
        queue, own, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(f[left] ^ f[queue.pop()]).sum(1) <= threshold
            if near.any():
                own.extend(left[near])
                queue.extend(left[near])
                left = left[~near]
        out.append(np.array(own))
    return out


def star_links(f: np.ndarray, starts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as row numbers (each linked row with the first of its component) within groups that start at these rows. Where ids are sorted in groups, a
    component has the same first id at most of its anchors, so that equal links fall together."""
    sizes = np.diff(np.r_[starts, len(f)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    for shift in range(1, int(min(SMALL_GROUP, sizes.max(initial=0)))):
        i = np.flatnonzero((group[:-shift] == group[shift:]) & small[shift:])
        near = i[np.bitwise_count(f[i] ^ f[i + shift]).sum(1) <= threshold]
        a.append(near)
        b.append(near + shift)
    for s, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
        for own in grown(f[s : s + n], threshold):
            a.append(np.full(len(own) - 1, s + own[0]))
            b.append(s + own[1:])
    return np.concatenate(a), np.concatenate(b)


def needed(anchor: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Which links (rows a, b) are not sure to be found elsewhere too.

    A pair within the threshold that differs in one bit at most in an earlier block is linked at the home of b there; one that does so in this block, at the home of b in this
    block. Links go to the first row of a component, so that what such a link would connect is connected by those: blocks and first rows only decrease.
    """
    blocks = np.ascontiguousarray(f, "<u8").view("<u4").reshape(len(f), -1)
    at = (anchor[a] >> 32).astype(np.int64)
    close = np.bitwise_count(blocks[a] ^ blocks[b]) <= 1
    direct = np.bitwise_count(f[a] ^ f[b]).sum(1) <= threshold
    earlier = (close & (np.arange(blocks.shape[1]) < at[:, None])).any(1)
    home = nearest_anchor(blocks[b, at])[0].astype(np.int64)
    here = close[np.arange(len(a)), at] & (home != (anchor[a] & 0xFFFFFFFF))
    return ~(direct & (earlier | here))


def _met(cols: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Which rows are in groups of several with a home."""
    sizes = np.diff(np.r_[starts, len(cols[0])])
    return np.repeat((sizes > 1) & np.maximum.reduceat(cols[2].astype(np.int8), starts).astype(bool), sizes)


_FOUND = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def compare(threshold: int, large: int) -> Callable:
    """Sorted rows (anchor, f, home) to links between fingerprints (key: -1, a, b), those left out that are sure to be found at another anchor. Of an anchor with more than
    `large` rows, each row comes back four times, with the anchor and one byte of its other block as key, and f as a. Such a group is never held as a whole."""

    def links(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = _met(cols, starts)
        key, f = cols[0][keep], cols[1][keep]
        if len(key):
            wide = f.view(np.uint64)[:, None]
            a, b = star_links(wide, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), threshold)
            use = needed(key, wide, a, b, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(use.sum()), -1)), *[pa.array(f[x[use]]) for x in (a, b)]], schema=_FOUND)

    def dealt(key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        bits = f.view(np.uint64)
        other = np.where(key >> 32 == 0, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)).astype(np.int64)
        part = np.concatenate([256 * i + (other >> 8 * i & 255) for i in range(4)])
        return pa.RecordBatch.from_arrays([pa.array(np.tile(key, 4) << 10 | part), pa.array(np.tile(f, 4)), pa.array(np.zeros(len(part), np.int64))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[np.ndarray] | None = None
        passing = None  # the anchor of a large group whose rows pass through
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if passing is not None:
                n = int(np.searchsorted(cols[0], passing, side="right"))
                if n:
                    yield dealt(cols[0][:n], cols[1][:n])
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                passing = None
            if wait is not None:
                cols = [np.concatenate(x) for x in zip(wait, cols, strict=True)]
                wait = None
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            sizes = np.diff(np.r_[starts, len(cols[0])])
            big = np.repeat(sizes > large, sizes)
            if big.any():
                yield dealt(cols[0][big], cols[1][big])
            last = int(starts[-1])
            own = [c[:last][~big[:last]] for c in cols]
            if len(own[0]):
                yield from links(own, np.flatnonzero(np.r_[True, own[0][1:] != own[0][:-1]]))
            if sizes[-1] > large:
                passing = cols[0][-1]
            else:
                wait = [c[last:] for c in cols]
        if wait is not None:
            yield from links(wait, np.zeros(1, np.int64))

    return run


def compare_parts(threshold: int) -> Callable:
    """Sorted rows (key, f) to links between fingerprints of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in groups(batches):
            a, b = star_links(cols[1].view(np.uint64)[:, None], starts, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][x]) for x in (a, b)], schema=_EDGES)

    return run


def linked(prints: DataFrame, threshold: int = THRESHOLD, large: int = LARGE_GROUP) -> DataFrame:
    """node, root: the components of the distinct fingerprints in prints (f: long) that have a link. threshold: at most 3, which two blocks of 32 bits cover."""
    if not 0 <= threshold <= 3:
        raise ValueError("two blocks cover at most 3 bits")
    rows = prints.select(F.col("f").alias("id"), "f").mapInArrow(replicate(1), "anchor long, id long, home boolean")
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "id")
    found = dealt.mapInArrow(compare(threshold, large), "key long, a long, b long").checkpoint()
    parts = found.filter("key >= 0").select("key", "a").repartition("key").sortWithinPartitions("key", "a")
    return components(found.filter("key < 0").select("a", "b").unionByName(parts.mapInArrow(compare_parts(threshold), "a long, b long")).distinct())


def simhash_components(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, f (long), component_id (the least doc_id that links lead to, itself included), one row for each row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Equal fingerprints are linked whatever their texts; null and empty texts
    have fingerprint 0; texts of any length are read as a whole, an empty table gives an empty table, other columns are ignored. Copies are counted once (map-side minimum by fingerprint) before they are replicated, so that a hot group is
    one row. Repeated rows are linked like any equal texts; a null doc_id never names a component, its row gets its component's id or null.
    """
    prints = fingerprints(docs, size).checkpoint()
    own = prints.groupBy("f").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    found = linked(own.select("f"), threshold).checkpoint()
    together = own.join(found, own["f"] == found["node"], "left").withColumn("root", F.coalesce("root", "f"))
    least = together.filter("node IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    named = together.filter("node IS NOT NULL OR n > 1").join(least, "root", "left").select("f", F.coalesce("least", "first").alias("component_id"))
    out = prints.join(named.withColumnRenamed("f", "of"), F.col("f") == F.col("of"), "left")
    return out.select("doc_id", "f", F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    out = simhash_components(docs, 3, 3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
