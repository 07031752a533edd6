from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from reachway.llm import warc

PAGES = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", None), (3, None, ""), (4, "u", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>é</p>"), (6, "u", "z" * 300_000), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (None, "u", "alone"), (-3, "u", "")]


def brute(pages):
    data = [(p, (h or "").encode()) for p, _, h in pages]
    top = {}
    for p, h in data:
        if p is not None:
            top[h] = max(p, top.get(h, p))
    out = []
    for p, h in data:
        first = top.get(h)
        again = first is not None and p != first
        out.append((p, len(h), warc.digest(h), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, sha int").repartition(3)
    path = warc.write_archives(df, str(tmp_path / "w"), compress=compress, archive_bytes=100_000)
    out = warc.read_archives(spark, path)
    assert out.filter("problem IS NOT NULL").count() == 0
    rows = out.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(PAGES)
    for r in rows:
        want = {(h or "").encode() for p, _, h in PAGES if p == r.page_id}
        assert bytes(r.payload) in (want if r.record_type == "response" else {b""})
    if compress:
        import gzip

        whole = gzip.decompress(open(glob.glob(path + "/part-*")[0], "rb").read())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_report_and_empty_tables(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.round_trip(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_least_size_of_shared_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    out = warc.read_archives(spark, warc.write_archives(df, str(tmp_path / "w"), min_bytes=3))
    assert {(r.page_id, r.record_type, r.refers_to) for r in out.collect()} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def ids(found):
    return [f.get("warc-record-id") for _, _, p, f, _ in found if p is None]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    records = [warc.record(i, f"u{i}", (f"page {i} " * 50).encode(), None, False) for i in range(8)]
    parts = [warc.member(r) if compress else r + b"\r\n\r\n" for r in records]
    whole = b"".join(parts)
    urn = lambda k: f"<{warc._URN}{k}>"
    assert ids(warc.salvage(whole)) == [urn(i) for i in range(8)]
    ends = [sum(map(len, parts[: i + 1])) for i in range(8)]
    rnd = random.Random(0)
    for k in range(8):
        start = ends[k] - len(parts[k])
        flipped = bytearray(whole)
        at = start + len(parts[k]) // 2 + rnd.randrange(20)
        flipped[at] ^= 0x55
        found = list(warc.salvage(bytes(flipped)))
        assert ids(found) == [urn(i) for i in range(8) if i != k]
        gap = [(s, e) for s, e, p, _, _ in found if p is not None]
        assert gap == [(start, ends[k])]
    cut = list(warc.salvage(whole[: ends[6] + 30]))
    assert ids(cut) == [urn(i) for i in range(7)] and [x[:2] for x in cut if x[2]] == [(ends[6], ends[6] + 30)]
    noise = bytes(rnd.randrange(256) for _ in range(500))
    mixed = list(warc.salvage(noise + parts[0] + noise + b"".join(parts[1:])))
    assert ids(mixed) == [urn(i) for i in range(8)] and sum(e - s for s, e, p, _, _ in mixed if p) == 1000
    assert list(warc.salvage(b"")) == [] and [x[2] is None for x in warc.salvage(b"junk")] == [False]
    both = list(warc.salvage(warc.member(records[0]) + records[1] + b"\r\n\r\n" + warc.member(records[2])))
    assert ids(both) == [urn(i) for i in range(3)]


def test_gaps_are_logged(spark, tmp_path):
    data = warc.member(warc.record(1, "u", b"x", None, False)) + b"broken" + warc.member(warc.record(2, "u", b"y", None, False))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    out = warc.read_archives(spark, str(tmp_path))
    log = warc.gaps(out).collect()
    assert len(log) == 1 and log[0].end - log[0].start == 6 and out.filter("problem IS NULL").count() == 2


def test_shared_digests_without_a_broadcast(spark, tmp_path):
    """More shared digests than are broadcast, hot ones among them: the same records."""
    html = ["hot"] * 40 + [f"pair {i // 2}" for i in range(30)] + [f"own {i}" for i in range(20)] + ["", None, "hot"]
    rows = [(i, f"u{i}", h) for i, h in enumerate(html)] + [(None, "n", "hot"), (None, "n", "none"), (5, "u5", "hot"), (200, "a", "x"), (200, "b", "x"), (200, "c", "y"), (201, "d", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    read = lambda path: sorted(((r.page_id, r.url, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).filter("page_id IS NOT NULL OR url IS NOT NULL").collect()), key=str)
    one = read(warc.write_archives(df, str(tmp_path / "a")))
    two = read(warc.write_archives(df, str(tmp_path / "b"), broadcast_digests=0, hot_rows=5))
    assert one == two and len(one) == len(rows)
    plan = warc._with_first(df.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.sha1(F.col("html").cast("binary")).alias("sha")), 0, 10**6, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sha" not in plan
