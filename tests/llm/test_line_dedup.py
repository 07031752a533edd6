from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from reachway.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs, min_chars=1):
    key = lambda x: x.strip(SPACE).translate(UP)
    lines = [(t or "").split("\n") for _, t in docs]
    seen = defaultdict(set)
    for i, ((doc, _), ls) in enumerate(zip(docs, lines, strict=True)):
        for x in ls:
            seen[key(x)].add(("row", i) if doc is None else doc)
    common = {k for k, v in seen.items() if len(v) >= min_docs and len(k) >= min_chars}
    return sorted((str(d), "\n".join(x for x in ls if key(x) not in common), len(ls), sum(key(x) in common for x in ls)) for (d, _), ls in zip(docs, lines, strict=True))


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(4)
    pool = ["Alpha beta", " alpha BETA\t", "Éa", "éa", "", "   ", "x", "\x0bx\x0c", "\x85x", "long " * 30]
    out = [(i, "\n".join(rnd.choice([*pool, f"own {i}"]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    return [*out, (100, None), (101, ""), (102, "\n\n"), (None, "x\nmine"), (None, "x\nmine"), (5, out[5][1]), (103, "x\n" * 3000 + "end")]


@pytest.mark.parametrize("keys", [10**6, 0])
def test_brute_force(spark, docs, keys):
    docs = docs + [(7, f"of one\nid\n{i % 3}") for i in range(20)] + [(None, "without\nid")] * 11
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for least, chars in ((2, 1), (10, 1), (10, 3), (40, 0)):
        out = line_dedup.drop_common_lines(df, least, chars, broadcast_keys=keys, broadcast_ids=keys)
        assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect()) == brute(docs, least, max(1, chars))


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb", "k", 3, 4)], "doc_id long, text string, k1 string, N_lines int, h1 int")
    out = line_dedup.drop_common_lines(df, 1)
    assert out.columns == ["doc_id", "text", "k1", "h1", "n_lines", "n_dropped"] and out.first().text == "" and out.first().k1 == "k"
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


def test_report(spark):
    r = line_dedup.line_report(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (r.n_lines, r.n_dropped, r.kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())


def test_repeated_rows_are_one_document_in_code_and_sql(spark):
    rows = [(1, "a line\nof its own")] * 12 + [(i, "shared by ten\n%d" % i) for i in range(2, 12)] + [(None, "no id\nhere")] * 10 + [(i, f"nine\n{i}") for i in range(2, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(df).collect())
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    assert got == sorted((str(d), n, k, h) for d, n, k, h in db.execute(line_dedup.ORACLE).fetchall())
    assert [g[2] for g in got if g[0] == "1"] == [0] * 12 and [g[2] for g in got if g[0] == "None"] == [2] * 10
