"""Every kind of personal data by plain Python, over cases and over a whole table."""

from __future__ import annotations

import datetime
import hashlib
import os
import random

import pytest
import regex

from reachway.llm import pii

SF = "/root/testdata/sf0.001"
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = "some key"
FIRST = datetime.date(1700, 1, 1)


def alphabet(c):
    return (0, 10) if c.isdigit() else (10, 26) if c.islower() else (36, 26)


def network(text, kind, hexadecimal=False):
    cells = [(SYMBOLS.index(c), *((0, 16) if hexadecimal else alphabet(c))) for c in text]
    left, right = cells[: len(cells) // 2], cells[len(cells) // 2 :]
    for i in range(1, 9):
        digest = hashlib.sha512(f"{KEY},{kind},{i},{len(left)},{' '.join(str(c) for c, _, _ in right)}".encode()).hexdigest()
        left, right = right, [(b + (c - b + int(digest[4 * (j % 32) :][:4], 16)) % r, b, r) for j, (c, b, r) in enumerate(left)]
    return "".join(SYMBOLS[c] for c, _, _ in left + right)


def number(value, a, b, kind):
    def word(i, x):
        return int(hashlib.sha256(f"{KEY},{kind},{i},{x}".encode()).hexdigest()[:12], 16)

    left, right = divmod(value, b)
    for i in range(1, 9):
        if i % 2:
            left = (left + word(i, right)) % a
        else:
            right = (right + word(i, left)) % b
    return left * b + right


def bare(m):
    return "".join(c for c in m if c in SYMBOLS)


def laid(m, symbols):
    it = iter(symbols)
    return "".join(next(it) if c in SYMBOLS else c for c in m)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def card(m):
    d = bare(m)
    if not 13 <= len(d) <= 19 or luhn(d) or not d.strip("0"):
        return None
    body = network(d[:-1], "card")
    return laid(m, body + next(c for c in "0123456789" if luhn(body + c) == 0))


def iban(m):
    d = bare(m)
    if not 15 <= len(d) <= 34 or mod97(d[4:] + d[:4]) != 1:
        return None
    body = network(d[4:], "iban")
    return laid(m, d[:2] + f"{98 - mod97(body + d[:2] + '00'):02d}" + body)


def ip(m):
    p = [int(x) for x in m.split(".")]
    if max(p) > 255:
        return None
    return ".".join(map(str, number(int.from_bytes(bytes(p)), 1 << 16, 1 << 16, "ip").to_bytes(4)))


def phone(m):
    d = bare(m)
    if not 8 <= len(d) <= 15:
        return None
    land = regex.match(pii._LANDS, d)[0]
    return laid(m, land + network(d[len(land) :], "phone"))


def ssn(m):
    a, g, s = map(int, m.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not g or not s:
        return None
    a, rest = divmod(number(areas.index(a) * 99 * 9999 + (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn"), 99 * 9999)
    return f"{areas[a]:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def day(y, m, d):
    try:
        n = (datetime.date(y, m, d) - FIRST).days
    except ValueError:
        return None
    return FIRST + datetime.timedelta(number(n, 189, 773, "date")) if 0 <= n < 189 * 773 else "out"


def iso(m):
    x = day(*map(int, m.split("-")))
    return x.isoformat() if isinstance(x, datetime.date) else None


def date(m):
    mark = m[len(regex.match("[0-9]+", m)[0])]
    a, b, y = map(int, m.split(mark)) if m.count(mark) == 2 else map(int, regex.split("[./]", m))
    for args, form in (((y, b, a), "%d{0}%m{0}%Y"), ((y, a, b), "%m{0}%d{0}%Y")):
        x = day(*args)
        if x is not None:
            return x.strftime(form.format(mark)) if x != "out" else None
    return None


def email(m):
    name, host = m.split("@")
    return laid(name, network(bare(name), "email")) + "@" + host if bare(name) else None


MAKERS = {"email": email, "secret": lambda m: network(m, "secret", True), "iban": iban, "ip": ip, "phone": phone, "ssn": ssn, "iso date": iso, "date": date, "card": card}


def number_at(text, i):
    """Length and new value of the longest valid card or IBAN that starts here."""
    if i and (text[i - 1] in SYMBOLS):
        return None
    after = lambda e: text[i + e : i + e + 1] not in tuple(SYMBOLS)
    if run := regex.match("[0-9](?:[ -]?[0-9])*", text[i : i + 200]):
        first, plus = not regex.search("[0-9][ -]$", text[:i][-2:]), text[:i].endswith("+")
        for e in range(len(run[0]), 0, -1):
            part = run[0][:e]
            likely = all(len(g) >= 4 for g in regex.split("[ -]", part)[:-1]) and len(regex.split("[ -]", part)) <= 5 and not (" " in part and "-" in part)
            if part[-1].isdigit() and after(e) and (likely or (first and e == len(run[0]))) and (not plus or len(bare(part)) > 15) and (v := card(part)):
                return e, "card", v
    elif run := regex.match("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*", text[i : i + 200]):
        for e in range(len(run[0]), 0, -1):
            part = run[0][:e]
            if after(e) and regex.fullmatch("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", part) and f"{part[:2]}{len(bare(part))}" in pii.IBAN_LENGTHS.split():
                return (e, "iban", v) if (v := iban(part)) else (e, None, part)
    return None


def brute(text):
    parts, at = [], 0
    for i in range(len(text)):
        if hit := number_at(text, i):
            end = i + hit[0]
            if i >= at:
                parts += [(None, text[at:i]), hit[1:]]
                at = end
            elif end > at and hit[1]:
                parts.append((hit[1], hit[2][at - i :]))
                at = end
    out, found = [], []
    for kind, t in [*parts, (None, text[at:])]:
        if kind:
            out.append(t)
            found.append((kind, t))
            continue
        at = 0
        for m in regex.finditer(pii.PATTERN, t):
            name = next(k for k, (_, form, _) in pii.FORMS.items() if regex.fullmatch(form, m[0]))
            if (new := MAKERS[name](m[0])) is not None:
                out += [t[at : m.start()], new]
                found.append((name.split()[-1], new))
                at = m.end()
        out.append(t[at:])
    return "".join(out), found


def numbers(rnd):
    def with_check(n):
        d = "".join(str(rnd.randrange(10)) for _ in range(n - 1))
        return d + next(c for c in "0123456789" if luhn(d + c) == 0)

    def bank(land, n):
        body = "".join(rnd.choice("0123456789ABCDEFGH") for _ in range(n))
        return land + f"{98 - mod97(body + land + '00'):02d}" + body

    cards = [with_check(n) for n in (13, 15, 16, 16, 16, 19)]
    grouped = [" ".join(c[i : i + 4] for i in range(0, len(c), 4)) for c in cards] + ["-".join(c[i : i + 4] for i in range(0, len(c), 4)) for c in cards]
    banks = [bank("DE", 18), bank("GB", 18), bank("NO", 11), bank("MT", 27)]
    banks += [" ".join(b[i : i + 4] for i in range(0, len(b), 4)) for b in banks]
    return [
        *cards, *grouped, *banks, cards[2][:-1] + str((int(cards[2][-1]) + 1) % 10), "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "+49 30 1234567", "+1 (504) 555-2652", "+15045552652", "+999", "123-45-6789", "666-45-6789", "899-99-9999",
        "1990-02-28", "1990-02-29", "1600-01-01", "28.02.1990", "2/28/1990", "31/02/1990", "7.11.2024", "07/11/1699", "a@b.co", "x.y-z+1@mail.example.org", "_@b.co", "A9@h-1.de", 'key = "0123456789abcdef0123456789abcdef"', "pw: 'ffffffffffffffffffffffffffffffffab'",
        "12", "2024", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "Tel.", "und", "(", ")", "x", "-", "é", "日本",
    ]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, [(x.kind, x.value) for x in r.pii]) for r in pii.pseudonymise(df, KEY).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i] == want, t[:300]
        kinds |= {k for k, _ in want[1]}
    return kinds


def test_mixed_lines(spark):
    rnd = random.Random(12)
    pool = numbers(rnd)
    lines = [rnd.choice([" ", ", ", "; ", " "]).join(rnd.choice(pool) for _ in range(rnd.randint(1, 9))) for _ in range(1_500)]
    assert check(spark, [*pool, *lines]) == {"card", "iban", *(k.split()[-1] for k in pii.FORMS)}


def test_rows_of_numbers_with_planted_values(spark):
    """Numbers and codes of all lengths in rows, with valid cards and IBANs among them."""
    rnd = random.Random(31)
    pool = [x for x in numbers(rnd) if bare(x) == x.translate({32: None, 45: None}) and len(bare(x)) > 12 and (card(x) if bare(x).isdigit() else iban(x))]
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    codes = lambda: rnd.choice(["REF", "AB12", "DE99", "X1", "WEST", digits(rnd.randint(1, 9)), digits(4), digits(2), digits(rnd.randint(10, 45))])
    rows = [rnd.choice([" ", " ", "-", ", ", "\n"]).join(rnd.choice(pool) if rnd.random() < 0.15 else codes() for _ in range(rnd.randint(1, 60))) for _ in range(600)]
    assert check(spark, rows) == {"card", "iban"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_whole_table(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert len(check(spark, texts)) > 3
