from __future__ import annotations

import random
from collections import defaultdict

from reachway.llm import rules
from reachway.llm.common import WORD


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    n = len(w)
    at = defaultdict(list)
    for i in range(n - 7):
        at[tuple(w[i : i + 8])].append(i)
    window = {k for p in at.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    span = {k for i, m in enumerate(best) if m >= rules.MIN_REPEAT for k in range(i, i + m)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = n < 20 or 100 * len(window) > 30 * n
    kept = not failed and len(span) <= rules.MAX_COVERED * n and max(best, default=0) <= rules.MAX_REPEAT
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(window), failed, kept


def test_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 50))) for _ in range(120)]
    base = [f"w{i}" for i in range(300)]
    texts += ["", None, "\n \n", "x " * 70, "a b\na b\n\nA b c # <|\x1cz", " ".join(base), " ".join(base + base[:60]), " ".join(base + base[:110]), " ".join(base[:40] * 3), "é" * 30 + "　x", "\n".join(["one two", "one two "] * 12)]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    out = {r.doc_id: r for r in rules.quality_rules(df.union(df).distinct()).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(t), t
    assert rules.quality_rules(df.limit(0)).count() == 0
    assert rules.quality_rules(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")).count() == 2


def test_long_texts_and_small_chunks():
    rnd = random.Random(1)
    long = " ".join(rnd.choice([f"v{i}" for i in range(50)]) for _ in range(60_000))
    (n, *_, longest), (_, _, _, _, repeat, span, top) = rules.measure([long, "same " * 50_000])
    assert n == 60_000 and longest < 20 and repeat == span == 50_000 and top == 49_999
