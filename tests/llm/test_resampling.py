from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa

from reachway.llm import resampling as R


def runs(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, order=2, buckets=10_000, percent=25, min_words=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, order)[1]) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = runs(x, order)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    out = [(i, f, w, s, k + 1) for k, (i, _, f, w, s) in enumerate(drawn)]
    left = Counter(rows) - Counter(drawn)
    return sorted(out + [(i, f, w, s, None) for i, _, f, w, s in left.elements()], key=str)


def texts(n, seed):
    rnd = random.Random(seed)
    pool = ["Alpha", "beta", "ÉTÉ", "été", "x1", "日本", "İ", "a_b", "don't", "\x00", "z" * 300, "-", "ß"]
    return [rnd.choice([" ", "\n", ", "]).join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 2, 19, 20, 21, 60]))) for _ in range(n)]


def same(spark, docs, target, **options):
    df = spark.createDataFrame([(i, x, 5, "k") for i, x in docs], "doc_id long, text string, weight int, able string")
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in R.resampling_ranks(df, bench, **options).collect()), key=str)
    assert got == brute(docs, target, **options)
    return df, bench, got


def test_brute_force(spark):
    docs = list(enumerate(texts(150, 1))) + [(500, None), (501, ""), (502, "word " * 30_000), (None, "one two " * 12), (None, "one two " * 12), (3, "same id " * 12), (503, "one two " * 12), (503, "one two " * 12)]
    _, _, got = same(spark, docs, [*texts(20, 2), None, ""])
    assert sum(r[4] is not None for r in got) > 10
    same(spark, docs, texts(20, 2), order=3, buckets=97, percent=50, min_words=1, seed=3)


def test_states_are_checksums_of_runs():
    for text in texts(40, 4):
        for order in (1, 2, 4):
            n, found = R.checksums(text, order)
            words, want = runs(text, order)
            assert n == words and Counter(found) == Counter(zlib.crc32(f.encode()) for f in want)


def test_empty_tables(spark):
    same(spark, [], [])
    same(spark, [(1, "a b " * 20), (2, "c d " * 20), (3, "e " * 20), (4, "f " * 20)], [])
    same(spark, [], ["a b"])


def test_drawn_rows_keep_their_columns(spark):
    docs = list(enumerate(texts(60, 9)))
    df, bench, got = same(spark, docs, texts(10, 2))
    out = R.resampled(df, bench)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in got if r[4] is not None)


def test_sql(spark):
    docs = [(i, x) for i, x in enumerate([*texts(80, 5), None, ""])]
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([x for _, x in docs], pa.string())}))
    db.register("benchmark", pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": pa.array(["alpha beta x1", None], pa.string())}))
    assert sorted(db.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({R.ORACLE})").fetchall(), key=str) == brute(docs, ["alpha beta x1", None])
