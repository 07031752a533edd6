from __future__ import annotations

import json
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from reachway.llm import packing

TEXTS = ["", None, "Hello world", "ñ<|endoftext|>x", "word " * 5000, "a\n\nb  c", "日本語", "x" * 300]


@pytest.mark.parametrize("n,k", [(1, 1), (2, 5), (7, 3), (200, 31)])
def test_differencing_partitions_evenly(n, k):
    rnd = random.Random(n)
    sizes = [rnd.randint(1, 256) for _ in range(n)]
    parts = packing.difference(sizes, k)
    assert sorted(i for p in parts for i in p) == list(range(n)) and len(parts) <= k
    if n > 6 * k:
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 8


def test_differencing_of_two_is_the_known_method():
    # 8, 7, 6, 5, 4: differences 1, 6, 5, 4 -> 2 (not the optimum, which is 0)
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_windows_rise_when_capacity_is_exceeded():
    windows = packing.pack([60, 60, 60], 100)
    assert len(windows) == 3
    assert packing.pack([], 10) == []


def plain(text):
    global _TOKENIZER
    if "_TOKENIZER" not in globals():
        _TOKENIZER = Tokenizer.from_file(packing.vocabulary())
    return _TOKENIZER.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_tokenizer_file():
    encode = packing.encoder(packing.vocabulary())
    for x in [*TEXTS, " " * 1_000_000, "\n" * 1_000_000, " \n" * 200_000, "<|endoftext|><|endoftext|> 's't're", "a" * 50_000]:
        assert encode(x or "") == plain(x or "")
    assert 50256 in encode("ñ<|endoftext|>x")


def test_same_ids_for_tokens_and_code_points():
    """Each token of the vocabulary, and code points of all planes among letters, digits, marks and blanks (every seventh; all agree)."""
    encode = packing.encoder(packing.vocabulary())
    with open(packing.vocabulary(), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    letters = packing._byte_letters()
    texts = [bytes(letters[c] for c in t).decode("utf-8", "replace") for t in tokens if t != "<|endoftext|>"]
    assert all(encode(t) == plain(t) for t in texts)
    codes = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(codes), 500):
        x = "".join(f"a{c}a1{c}1 {c}{c} .{c}. {c}\n" for c in codes[i : i + 500])
        assert encode(x) == plain(x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_same_ids_for_whole_tables():
    encode = packing.encoder(packing.vocabulary())
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        assert encode(t or "") == plain(t or "")


def test_other_files_and_failures_go_to_tokenizers(tmp_path, monkeypatch):
    with open(packing.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert packing._ranked(str(tmp_path / "t.json")) is None
    assert packing.encoder(str(tmp_path / "t.json"))("word") == Tokenizer.from_file(str(tmp_path / "t.json")).encode("word", add_special_tokens=False).ids

    class Panic(BaseException):
        pass

    def fails(text):
        raise Panic

    monkeypatch.setattr(packing, "_ranked", lambda path: fails)
    assert packing.encoder.__wrapped__(packing.vocabulary())("some text") == plain("some text")


def fewest(sizes, capacity):
    """The least number of windows, by trying all."""

    def go(i, sums):
        if i == len(sizes):
            return len(sums)
        best = len(sizes) + 1
        for k, s in enumerate(sums):
            if s + sizes[i] <= capacity and s not in sums[:k]:
                best = min(best, go(i + 1, (*sums[:k], s + sizes[i], *sums[k + 1 :])))
        return min(best, go(i + 1, (*sums, sizes[i])))

    return go(0, ())


def test_small_cases_by_brute_force():
    rnd = random.Random(3)
    more = 0
    for _ in range(300):
        sizes = [rnd.randint(1, 25) for _ in range(rnd.randint(1, 8))]
        windows = packing.pack(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 100 for w in windows)
        more += len(windows) - fewest(sizes, 100)
        assert len(windows) <= fewest(sizes, 100) + 1
    assert more <= 5


def test_pieces(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["alpha", "bei", "c", "ungewöhnlich"]) for _ in range(rnd.randint(0, 900)))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    out = packing.pack_documents(df.selectExpr("*", "1 AS start", "'x' AS sequence_id")).toPandas()
    encode = packing.encoder(packing.vocabulary())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out.itertuples():
        by_doc[None if np.isnan(r.doc_id) else int(r.doc_id)].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in docs:
        ids = np.array([*encode(t or ""), 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert out.length.sum() / 1024 / len(by_seq) > 0.98
    assert packing.pack_documents(df.limit(0)).count() == 0
