"""The SQL of operators over texts that the test tables don't have."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa

from reachway.llm import licenses, rules
from tests.llm.test_license_layouts import TEXTS


def both(spark, texts, report, oracle):
    rows = list(enumerate(texts))
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    df = report(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r[c] for c in df.columns) for r in df.collect())
    found = db.execute(oracle)
    names = [d[0] for d in found.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want
    return got


def test_whole_licence_texts(spark):
    marked = ["\n".join(mark + line for line in text.split("\n")) for mark in ("", "# ", " * ", "// ") for text in TEXTS.values()]
    joined = ["\n\n".join(rnd.sample(list(TEXTS.values()), 3)) for rnd in map(random.Random, range(12))]
    got = both(spark, [*marked, *joined, None, "", "All rights reserved. " * 500, "Licensed under the Apache License, Version 2.0. All rights reserved."], licenses.license_report, licenses.ORACLE)
    assert sum(bool(r[2]) for r in got) >= len(marked) + len(joined)


def test_repeats(spark):
    rnd = random.Random(9)
    word = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    texts = [None, "", " \n\t", "a " * 30, word(19), word(20), "x\n" * 12 + "# $\n" * 9]
    for n in (7, 8, 9, 99, 100, 101, 150):
        part = word(n)
        texts += [f"{part} {word(400)} {part}", f"{word(30)}\n{part}\n{word(600)} {part} {word(5)} {part[: len(part) // 2]}"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    got = both(spark, texts, rules.rules_report, rules.ORACLE)
    assert {r[-1] for r in got} == {True, False}
