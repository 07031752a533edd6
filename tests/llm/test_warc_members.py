"""Records inside gzip members of several, damaged in several ways."""

from __future__ import annotations

import random
import zlib

import pytest

from reachway.llm import warc

RECORDS = [warc.record(i, f"u{i}", random.Random(i).randbytes(3_000).hex().encode(), None, False) + b"\r\n\r\n" for i in range(5)]


def squeezed(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def ids(found):
    return [int(f["warc-record-id"].rpartition(":")[2][:-1]) for _, _, p, f, _ in found if p is None]


@pytest.mark.parametrize("bad", range(5))
def test_a_bad_record_costs_only_itself(bad):
    broken = bytearray(RECORDS[bad])
    broken[-100] ^= 1
    data = squeezed(b"".join([*RECORDS[:bad], bytes(broken), *RECORDS[bad + 1 :]]))
    found = list(warc.salvage(data + warc.member(RECORDS[0][:-4])))
    assert ids(found) == [i for i in range(5) if i != bad] + [0]
    (gap,) = [x for x in found if x[2]]
    assert gap[:2] == (0, len(data)) and "member" in gap[2]


def test_a_cut_or_damaged_member_gives_what_lies_before():
    data = squeezed(b"".join(RECORDS))
    cut = list(warc.salvage(data[: int(len(data) * 0.7)]))
    assert ids(cut) == [0, 1, 2] and [x[:2] for x in cut if x[2]] == [(0, int(len(data) * 0.7))]
    wrong = bytearray(data)
    wrong[-6] ^= 1  # the member's check sum
    sums = list(warc.salvage(bytes(wrong) + warc.member(RECORDS[4][:-4])))
    assert ids(sums) == [0, 1, 2, 3, 4] and [x[:2] for x in sums if x[2]] == [(0, len(data))]


def test_a_long_url_in_a_table(spark):
    df = spark.createDataFrame([(1, "data:," + "x" * 1_000_000, "a"), (2, "u", "b" * 3_000_000), (3, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(df).collect()) == [(1, 1), (2, 3_000_000), (3, 0)]


def test_lost_pages_are_not_passed_over(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "write_archives", lambda pages, path: _one_broken(spark, path))
    with pytest.raises(Exception, match="no version line|digest|member"):
        warc.round_trip(df)


def _one_broken(spark, path):
    import os

    os.makedirs(path)
    with open(path + "/a.warc.gz", "wb") as f:
        f.write(warc.member(warc.record(1, "u", b"a", None, False)) + b"junk" + warc.member(warc.record(2, "u", b"b", None, False)))
    return path
