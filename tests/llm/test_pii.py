from __future__ import annotations

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from reachway.llm import pii


def luhn(x):
    d = [int(c) for c in x][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def card(x, key=pii.KEY):
    """The network in plain Python, over digits."""
    s = [int(c) for c in x[:-1]]
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        h = hashlib.sha512(f"{key},card,{i},{len(left)},{' '.join(map(str, right))}".encode()).hexdigest()
        left, right = right, [(v + int(h[4 * (j % 32) : 4 * (j % 32) + 4], 16)) % 10 for j, v in enumerate(left)]
    body = "".join(map(str, left + right))
    return body + str(-luhn(body + "0") % 10)


def masked(spark, texts, key=pii.KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [x.kind for x in r.pii], [x.value for x in r.pii]) for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_cards_follow_the_network_and_stay_linked(spark):
    a, b, c, d = masked(spark, ["pay 4111 1111 1111 1111 now", "4111-1111-1111-1111### 4111111111111111", "no 4111111111111112", "378282246310005"])
    want = card("4111111111111111")
    assert a[0] == f"pay {want[:4]} {want[4:8]} {want[8:12]} {want[12:]} now" and luhn(want) == 0
    assert b[0] == f"{want[:4]}-{want[4:8]}-{want[8:12]}-{want[12:]}### {want}" and b[1] == ["card", "card"]
    assert c == ("no 4111111111111112", [], []) and d[0] == card("378282246310005")


def test_formats(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01", "from 152.143.123.131, not 999.1.1.1 or 1.2.3.4.5", "+1 (504) 555-2652 is +15045552652; +49 30 1234567", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"',
        "123-45-6789 but 000-12-3456 and 666-12-3456", "1990-02-28 28.02.1990 2/28/1990 1990-02-29 31/02/1990", "write.to99@mail3.example.com", None, "", "x" * 200_000,
    ]
    out = masked(spark, texts)
    assert [o[1] for o in out] == [["iban"], ["ip"], ["phone"] * 3, ["secret"], ["ssn"], ["date"] * 3, ["email"], [], [], []]
    iban = out[0][2][0].replace(" ", "")
    assert iban[:2] == "DE" and mod97(iban[4:] + iban[:4]) == 1 and out[0][0].endswith("DE89 3704 0044 0532 0130 01")
    assert all(int(p) < 256 for p in out[1][2][0].split(".")) and "999.1.1.1 or 1.2.3.4.5" in out[1][0]
    assert out[2][2][0].replace(" (", "").replace(") ", "").replace("-", "") == out[2][2][1] and out[2][2][2].startswith("+49 ")
    assert len(out[3][2][0]) == 40 and int(out[3][2][0], 16) >= 0
    area, group, serial = map(int, out[4][2][0].split("-"))
    assert area not in (0, 666) and area < 900 and group and serial
    iso, german, american = out[5][2]
    day = datetime.date.fromisoformat(iso)
    assert german == day.strftime("%d.%m.%Y") and american == day.strftime("%m/%d/%Y") and "1990-02-29" in out[5][0]
    assert out[6][0].endswith("@mail3.example.com") and out[6][0][5] == "." and out[6][0] != texts[6]
    assert out[7] == (None, [], []) and out[8] == ("", [], []) and out[9][0] == texts[9]


@pytest.mark.parametrize("make,n", [("date_format(date_add(date'1750-01-01', cast(id as int)), 'yyyy-MM-dd')", 9000), ("concat('10.0.', cast(id div 200 as int), '.', id % 200)", 9000), ("concat('123-45-', lpad(id + 1, 4, '0'))", 9000)])
def test_permutations_lose_nothing(spark, make, n):
    df = spark.range(n).selectExpr("id AS doc_id", f"{make} AS text")
    out = pii.pseudonymise(df, pii.KEY)
    r = out.agg(F.countDistinct("text"), F.sum("n_pii")).first()
    assert tuple(r) == (n, n)
    other = pii.pseudonymise(df, "another key")
    assert out.join(other, ["doc_id", "text"]).count() < n / 100


def test_tables(spark):
    df = spark.createDataFrame([(1, "a@b.com", 5, "r"), (1, "a@b.com", 5, "r"), (None, None, None, None)], "doc_id long, text string, N_PII int, row string")
    out = pii.pseudonymise(df, pii.KEY)
    assert out.columns == ["doc_id", "text", "row", "n_pii", "pii"] and [r.n_pii for r in out.collect()] == [1, 1, 0]
    assert pii.pseudonymise(df.limit(0), pii.KEY).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
