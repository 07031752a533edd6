from __future__ import annotations

import random

import pytest

from reachway.llm import decontaminate as d

WORDS = [f"t{i}" for i in range(400)]


def coverage(item, text, least=d.MIN_MATCH):
    """Greedy string tiling by looking at all pairs of places."""
    a, b = d.tokens(item), d.tokens(text)
    if len(a) < least:
        return 0.0
    ma, mb = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if (-k, i, j) < best or best == (0, 0, 0) and k:
                    best = (-k, i, j)
        k = -best[0]
        if k < least:
            return sum(ma) / len(a)
        for x in range(k):
            ma[best[1] + x] = mb[best[2] + x] = True


def test_tiling_equals_brute_force():
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice(WORDS[:5]) for _ in range(rnd.randint(3, 24)))) for i in range(25)]
    texts = [" ".join(rnd.choice(WORDS[:5]) for _ in range(rnd.randint(0, 60))) for _ in range(25)]
    for _, t in items[:12]:
        w = t.split()
        texts.append(" ".join(["zz", *w[len(w) // 2 :], "yy", *w[: len(w) // 2]]))
    bench = d.Benchmark(items)
    for least in (0.2, 0.6):
        got = {(k, i): round(c, 9) for k, i, c in bench.leaks(texts, least)}
        want = {(k, i): round(c, 9) for k, t in enumerate(texts) for i, item in items if (c := coverage(item, t)) >= least}
        assert got == want and len(want) > 8


@pytest.mark.parametrize("block", [10**6, 40])
def test_reordered_passages_in_tables(spark, block):
    rnd = random.Random(2)
    item = [rnd.choice(WORDS) for _ in range(40)]
    clean = " ".join(rnd.choice(WORDS) for _ in range(3000))
    docs = [(1, clean), (2, clean + " " + " ".join(item[20:]) + " - " + " ".join(item[:20])), (3, "Intro. " + ", ".join(item).upper()), (4, None), (5, ""), (6, " ".join(item[:20])), (7, " ".join(item[::2])), (None, " ".join(item)), (2, clean)]
    df = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, leaking int, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "..."), (13, " ".join(WORDS[200:230])), (14, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in d.leaks(df, bench, block_chars=block).collect()}
    assert got == {(i, j, 1.0) for i in (2, 3, None) for j in (10, 14)}
    assert sorted(r.doc_id for r in d.decontaminated(df, bench).collect()) == [1, 4, 5, 6, 7]
    report = d.leak_report(df, bench).collect()
    assert len(report) == len(docs) and {(r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids), r.coverage) for r in report if r.contaminated} == {(i, True, 2, (10, 14), 1.0) for i in (2, 3, None)}
    assert d.leaks(df.limit(0), bench).count() == 0 and d.leaks(df, bench.limit(0)).count() == 0


def test_seeds_in_blocks_give_the_same_runs(monkeypatch):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(5, 40)))) for i in range(8)]
    texts = [" ".join(rnd.choice("abc") for _ in range(300)) for _ in range(8)]
    want = sorted(d.Benchmark(items).leaks(texts, 0.1))
    monkeypatch.setattr(d, "SEED_BLOCK", 7)
    assert sorted(d.Benchmark(items).leaks(texts, 0.1)) == want and want


def test_repeated_passages_stay_bounded():
    """A passage that all items and the text repeat: seeds are 800,000 pairs an item, runs some thousand."""
    items = [(i, "la " * 200 + f"own{i}") for i in range(5)] + [(99, "yes"), (98, "no no")]
    got = list(d.Benchmark(items).leaks(["la " * 4_000, "yes", "no no no"], 0.6))
    assert sorted((k, i) for k, i, _ in got) == [(0, i) for i in range(5)]
    assert all(abs(c - 200 / 201) < 1e-9 for _, _, c in got)
