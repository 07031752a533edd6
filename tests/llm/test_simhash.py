from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from reachway.llm import near_dedup, simhash
from reachway.llm.components import components

WORDS = [f"w{i}" for i in range(900)]
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []


def fingerprint(text, size=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(n, links, ids):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(n):
        members[find(i)].append(i)
    return {i: min((ids[j] for j in m if ids[j] is not None), default=None) for m in members.values() for i in m}


def near(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = rnd.choice(WORDS)
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(6)
    out = [None, "", " \t\n", "a", "A", "a b", "a b c d", "Éa b c", "éa b c", "x " * 40_000]
    for _ in range(60):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(40, 300))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 6])):
            out.append(" ".join(near(rnd, base, rnd.randint(0, 4))))
    hot = [rnd.choice(WORDS) for _ in range(400)]
    out += [" ".join(near(rnd, hot, rnd.randint(0, 3))) for _ in range(80)]
    return out


def test_every_pair_within_a_bit_meets_at_a_home():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    row, anchor, home = simhash.anchors(x)
    assert np.bitwise_count(x[row] ^ anchor).max() == 2 and np.bitwise_count(x[row] ^ anchor)[home].max() == 1
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    for bit in [None, *range(32)]:
        y = x if bit is None else x ^ np.uint32(1 << bit)
        r, a, _ = simhash.anchors(y)
        reach = defaultdict(set)
        for i, c in zip(r.tolist(), a.tolist(), strict=True):
            reach[i].add(c)
        assert all(homes[i] in reach[i] for i in range(300))


def test_fingerprints_and_components(spark, texts):
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, [1] * len(texts), strict=True)), "doc_id long, text string, f int").repartition(3)
    f = [fingerprint(t) for t in texts]
    out = {r.doc_id: r for r in simhash.simhash_report(df).collect()}
    assert [out[i].fingerprint for i in ids] == [f"{x:016x}" for x in f]
    links = [(i, j) for i in ids for j in ids[:i] if (f[i] ^ f[j]).bit_count() <= 3]
    want = classes(len(ids), links, ids)
    assert {i: out[i].component_id for i in ids} == want and len(set(want.values())) < len(ids) - 60
    assert out[0].component_id == out[1].component_id == out[2].component_id == 0


def test_ids_that_are_null_or_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q w e r t y")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()), key=str) == [(5, 5), (5, 5), (7, 5), (None, 5), (None, None)]
    assert simhash.simhash_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.linked(df.selectExpr("doc_id AS f"), 4)


def test_chains_of_fingerprints(spark):
    # each differs from the last in three bits: one component, though its ends are far apart
    chain = [0]
    for i in range(20):
        chain.append(chain[-1] ^ (7 << 3 * i))
    prints = spark.createDataFrame([(simhash.signed(x),) for x in [*chain, 0xF0F0F0F0F0F0F0F0]], "f long")
    got = simhash.linked(prints).collect()
    assert len(got) == 21 and len({r.root for r in got}) == 1


@pytest.mark.parametrize("large", [1, 3, 50])
def test_large_groups_are_dealt_by_bytes(spark, large):
    rnd = np.random.default_rng(large)
    base = rnd.integers(0, 1 << 63, 3, dtype=np.uint64)
    f = base[rnd.integers(0, 3, 500)]
    for _ in range(5):
        f ^= np.where(rnd.random(500) < 0.6, np.uint64(1) << rnd.integers(0, 64, 500, dtype=np.uint64), np.uint64(0))
    f = np.unique(f)
    prints = spark.createDataFrame([(simhash.signed(int(x)),) for x in f], "f long")
    got = {r.node: r.root for r in simhash.linked(prints, large=large).collect()}
    every = [(i, j) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= 3]
    want = classes(len(f), every, [simhash.signed(int(x)) for x in f])
    assert got == {simhash.signed(int(f[i])): want[i] for e in every for i in e} and len(got) > 100


def test_large_groups_equal_small_ones():
    rnd = np.random.default_rng(3)
    f = np.unique(np.uint64(12345) ^ (np.uint64(1) << rnd.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 400, dtype=np.uint64)))
    ids = np.arange(len(f))
    a, b = simhash.star_links(f[:, None], np.zeros(1, np.int64), 3)
    links = [*zip(a.tolist(), b.tolist(), strict=True)]
    every = [(i, j) for i in ids for j in ids[:i] if int(f[i] ^ f[j]).bit_count() <= 3]
    assert classes(len(f), links, ids.tolist()) == classes(len(f), every, ids.tolist()) and len(links) < len(f)


def test_links_left_out_are_found_elsewhere():
    rnd = np.random.default_rng(11)
    for wide, threshold, flips in ((1, 3, 4), (6, 84, 30)):
        base = rnd.integers(0, 1 << 63, (4, wide), dtype=np.uint64)
        f = base[rnd.integers(0, 4, 160)]
        for _ in range(flips):
            f[np.arange(160), rnd.integers(0, wide, 160)] ^= np.where(rnd.random(160) < 0.5, np.uint64(1) << rnd.integers(0, 64, 160, dtype=np.uint64), np.uint64(0))
        f = np.unique(f, axis=0)
        rows = []
        for block in range(2 * wide):
            r, anchor, home = simhash.anchors((f[:, block // 2] >> np.uint64(32 * (block % 2))).astype(np.uint32))
            rows += [((block << 32) + int(c), int(i), bool(h)) for i, c, h in zip(r, anchor, home, strict=True)]
        rows.sort()
        key, ids = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        keep = simhash._met([key, ids, np.array([x[2] for x in rows])], starts)
        key, ids = key[keep], ids[keep]
        a, b = simhash.star_links(f[ids], np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), threshold)
        use = simhash.needed(key, f[ids], a, b, threshold)
        every, some = ([*zip(ids[x].tolist(), ids[y].tolist(), strict=True)] for x, y in ((a, b), (a[use], b[use])))
        assert classes(len(f), every, list(range(len(f)))) == classes(len(f), some, list(range(len(f)))) and len(some) < 0.7 * len(every)


def test_components(spark):
    rnd = random.Random(1)
    e = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(900, i) for i in range(901, 980)] + [(None, 1), (5, 5)]
    df = spark.createDataFrame([*e, *e[:20]], "a long, b long").repartition(6)
    got = {r.node: r.root for r in components(df).collect()}
    assert {r.node: r.root for r in components(df, centre=5).collect()} == got
    want = classes(1000, [x for x in e if None not in x], list(range(1000)))
    linked = {i for x in e if None not in x and x[0] != x[1] for i in x}
    assert got == {i: want[i] for i in linked} and components(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk,ids_bound,chunk_rows,wide_rows", [(2_000_000, 10**6, 128, 2_048), (2_000, 0, 128, 2_048), (2_000_000, 10**6, 3, 20), (2_000_000, 10**6, 30, 7), (2_000_000, 0, 1, 10**6)])
def test_near_duplicates_equal_exact_jaccard(spark, texts, chunk, ids_bound, chunk_rows, wide_rows):
    ids = [3 * i + 1 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ["z"] * len(texts), strict=True)), "doc_id long, text string, gone string").repartition(4)
    sets = [frozenset(shingles(t, 5)) for t in texts]
    keys = [" ".join(shingles(t, 1)) for t in texts]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if keys[i] == keys[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    want = classes(len(ids), links, ids)
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicate_groups(df, chunk_shingles=chunk, broadcast_ids=ids_bound, chunk_rows=chunk_rows, wide_rows=wide_rows).collect()}
    assert got == {i: want[k] for k, i in enumerate(ids)}
    if chunk_rows == 128 and chunk > 2_000:
        kept = near_dedup.deduplicated(df)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
        assert near_dedup.deduplicated(df.limit(0)).count() == 0


def test_similar_sets():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 1 << 62, 100, dtype=np.uint64))
    sets = [np.sort(np.r_[base[k:], np.arange(k, dtype=np.uint64)]) for k in range(0, 60, 3)] + [np.array([5], np.uint64)]
    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    got = near_dedup.similar(sets, 0.8)
    want = classes(len(sets), every, list(range(len(sets))))
    assert {i: min(g) for g in got for i in g} == want
