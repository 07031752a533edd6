"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern, validated (Luhn and mod-97 checks, number ranges, real calendar days), and replaced by a keyed
permutation of their own format: a Feistel network over the value's symbols, each in its own alphabet, with SHA-512 of key, kind, round and
the other half as the round function. A permutation maps equal values to equal pseudonyms, in whatever document or layout
they stand, and different values to different ones; checks are computed anew, so that a pseudonym is valid in its format.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key of the registered query where the session has none. It is public: whoever knows it can invert pseudonyms, so that the operator itself never takes it by default.
KEY = "reachway-demo-key"
#: The session's setting that holds the key.
KEY_SETTING = "spark.reachway.pii.key"
ROUNDS = 8
#: Symbols by code: digits, lower-case and upper-case letters.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Kind: what may not stand before, the candidate's form, what may not stand after. Loops are over single characters or bounded (a host has 127 labels at
#: most, by its 253 characters), or else possessive: Java's loops over groups take stack for each turn.
FORMS = {
    "email": (r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++){0,126}(?<=\.[A-Za-z]{2,63})", ""),
    "secret": (r"(?<=[=:][ ]{0,2}[\"'])", r"[0-9a-f]{32,}+", r"(?=[\"'])"),
    "ip": (r"(?<![0-9.])", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"(?![0-9]|\.[0-9])"),
    "phone": (r"(?<![0-9A-Za-z+])", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}", r"(?![0-9])"),
    "ssn": (r"(?<![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9]|-[0-9])"),
    "iso date": (r"(?<![0-9./-])", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"(?![0-9]|[./-][0-9])"),
    "date": (r"(?<![0-9./-])", r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}", r"(?![0-9]|[./-][0-9])"),
}
PATTERN = "|".join(f"{before}(?:{form}){after}" for before, form, after in FORMS.values())
#: Places where a card or an IBAN may start, whatever stands before, and as much as may belong to it, with one letter or digit more where one follows. Matches are empty, so that
#: candidates overlap: every start is tried. Cards start a run of digits or with four digits; what a run of digits has besides doesn't matter.
NUMBER = (
    r"(?<![0-9A-Za-z])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?: ?[0-9A-Za-z])?|"
    r"(?:(?<![0-9][ -])|(?=[0-9]{4}))[0-9](?:[ -]?[0-9]){12,18}(?:[ -]?[0-9A-Za-z])?))"
)
_CARD_LAYOUT = "^(?:(?:[0-9]{4,} ){0,4}|(?:[0-9]{4,}-){0,4})[0-9]+$"
_IBAN_LAYOUT = "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"
# Countries and lengths of their IBANs, by the public registry (ISO 13616).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 "
    "TR26 UA29 VA22 VG24 XK20 YE30"
)
#: What any candidate has (tested): an at sign, two digits with a mark between them at most, or a quoted run of hexadecimal digits.
_HINT = r"@|[0-9][ .-]?[0-9]|[\"'][0-9a-f]{32}"
#: Country codes by the ITU's list (E.164), which is free of prefixes: those of one and two digits, all others have three.
_LANDS = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Days from 1700-01-01 to 2099-12-31: 400 Gregorian years, in two factors for the halves of a Feistel network.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _codes(text: Column, alphabet: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A symbol string to an array of (code, base, radix); alphabet(code, position) gives base and radix."""

    def one(c: Column, i: Column) -> Column:
        def at(v: Column) -> Column:
            base, radix = alphabet(v, i)
            return F.struct(v.alias("c"), base.cast("int").alias("b"), radix.cast("int").alias("r"))

        return let((F.position(c, F.lit(SYMBOLS)) - 1).cast("int"), at)

    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)


def _plain(code: Column, _: Column) -> tuple[Column, Column]:
    """Digits stay digits, letters keep their case."""
    return F.when(code < 10, 0).when(code < 36, 10).otherwise(36), F.when(code < 10, 10).otherwise(26)


def _hex(_: Column, __: Column) -> tuple[Column, Column]:
    return F.lit(0), F.lit(16)


def feistel(symbols: Column, kind: str, key: str) -> Column:
    """The permuted symbol string of an array of (code, base, radix)."""

    def add(half: Column, other: Column, i: Column) -> Column:
        said = F.concat_ws(",", F.lit(key), F.lit(kind), i.cast("string"), F.size(half).cast("string"), F.array_join(F.transform(other, lambda x: x["c"].cast("string")), " "))

        def shifted(digest: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                word = F.conv(F.substring(digest, F.pmod(j, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                c = (x["b"] + F.pmod(x["c"] - x["b"] + word, x["r"])).cast("int")
                return F.struct(c.alias("c"), x["b"].alias("b"), x["r"].alias("r"))

            return F.transform(half, one)

        return let(F.sha2(said, 512), shifted)

    def network(s: Column) -> Column:
        half = F.floor(F.size(s) / 2).cast("int")
        start = F.struct(F.slice(s, F.lit(1), half).alias("l"), F.slice(s, half + 1, F.size(s) - half).alias("r"))
        step = lambda acc, i: F.struct(acc["r"].alias("l"), add(acc["l"], acc["r"], i).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))

    return F.array_join(F.transform(let(symbols, network), lambda x: F.substring(F.lit(SYMBOLS), x["c"] + 1, F.lit(1))), "")


def mixed(value: Column, a: int, b: int, kind: str, key: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: a Feistel network over remainders."""

    def word(x: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(",", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        left = F.when(odd, F.pmod(acc["l"] + word(acc["r"], i), F.lit(a))).otherwise(acc["l"])
        right = F.when(odd, acc["r"]).otherwise(F.pmod(acc["r"] + word(acc["l"], i), F.lit(b)))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["l"] * b + acc["r"])


def laid_out(layout: Column, symbols: Column) -> Column:
    """layout with its letters and digits replaced, one after another, by these symbols."""
    step = lambda acc, c: F.when(
        c.rlike("^[0-9A-Za-z]$"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["s"], F.substring(symbols, acc["i"], F.lit(1))).alias("s"))
    ).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["s"], c).alias("s")))
    return F.aggregate(F.split(layout, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def luhn(digits: Column) -> Column:
    """The sum of the Luhn check over these digits, modulo 10."""

    def step(acc: Column, c: Column) -> Column:
        v = c.cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.struct((acc["n"] + 1).alias("n"), (acc["s"] + F.when(acc["n"] % 2 == 1, twice).otherwise(v)).alias("s"))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("s")), step, lambda acc: acc["s"] % 10)


def mod97(text: Column) -> Column:
    """Letters and digits as one number (A is 10), modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        code = F.position(c, F.lit(SYMBOLS)).cast("int") - 1
        v = F.when(code > 35, code - 26).otherwise(code)
        return (F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97).cast("int")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _two(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        def checked(body: Column) -> Column:
            return F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

        body = let(feistel(_codes(F.substring(d, F.lit(1), F.length(d) - 1), _plain), "card", key), checked)
        return let(body, lambda s: laid_out(m, s))

    return let(bare(m), lambda d: F.when(F.length(d).between(13, 19) & (luhn(d) == 0) & ~d.rlike("^0+$"), changed(d)))


def _iban(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        land = F.substring(d, 1, 2)

        def checked(body: Column) -> Column:
            return F.concat(land, _two(98 - mod97(F.concat(body, land, F.lit("00"))), 2), body)

        return let(let(feistel(_codes(F.substring(d, F.lit(5), F.length(d) - 4), _plain), "iban", key), checked), lambda s: laid_out(m, s))

    return let(bare(m), lambda d: F.when(F.length(d).between(15, 34) & (mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1), changed(d)))


def _ip(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        def changed(n: Column) -> Column:
            return F.concat_ws(".", *[F.pmod(F.floor(n / d), F.lit(256)).cast("string") for d in (1 << 24, 1 << 16, 1 << 8, 1)])

        value = reduce(lambda x, y: x * 256 + y, [F.element_at(p, i).cast("long") for i in range(1, 5)])
        return F.when(F.forall(p, lambda x: x.cast("int") < 256), let(mixed(value, 1 << 16, 1 << 16, "ip", key), changed))

    return let(F.split(m, r"\."), of)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; it is read from the digits, so that it is the same in all layouts."""

    def of(d: Column) -> Column:
        land = F.regexp_extract(d, _LANDS, 0)

        def changed(code: Column) -> Column:
            rest = F.substring(d, F.length(code) + 1, F.length(d))
            return let(F.concat(code, feistel(_codes(rest, _plain), "phone", key)), lambda s: laid_out(m, s))

        return F.when(F.length(d).between(8, 15), let(land, changed))

    return let(bare(m), of)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    fine = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # 0 .. 897
    n = rank * (99 * 9999) + (group - 1) * 9999 + serial - 1

    def changed(v: Column) -> Column:
        r = F.floor(v / (99 * 9999))
        a = F.when(r >= 665, r + 2).otherwise(r + 1)
        return F.concat_ws("-", _two(a, 3), _two(F.pmod(F.floor(v / 9999), F.lit(99)) + 1, 2), _two(F.pmod(v, F.lit(9999)) + 1, 4))

    return F.when(fine, let(mixed(n, 898, 99 * 9999, "ssn", key), changed))


def _day(d: Column, key: str, out: Callable[[Column], Column]) -> Column:
    """out of the day that takes d's place; null where d is null or out of range."""

    def changed(n: Column) -> Column:
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), let(F.date_add(F.to_date(F.lit(FIRST_DAY)), mixed(n, *DAYS, "date", key).cast("int")), out))

    return let(F.datediff(d, F.to_date(F.lit(FIRST_DAY))).cast("long"), changed)


def _iso_date(m: Column, key: str) -> Column:
    return _day(F.try_to_date(m, "yyyy-MM-dd"), key, lambda d: F.date_format(d, "yyyy-MM-dd"))


def _date(m: Column, key: str) -> Column:
    """Day first where that is a calendar day, or else month first."""

    def of(p: Column) -> Column:
        a, b, y = (F.element_at(p, i) for i in (1, 2, 3))
        mark = F.substring(m, F.length(a) + 1, F.lit(1))
        found = [F.try_to_date(F.concat_ws("-", y, _two(x, 2), _two(z, 2)), "yyyy-MM-dd") for x, z in ((b, a), (a, b))]

        def written(order: tuple[str, str]) -> Callable[[Column], Column]:
            return lambda d: F.concat(F.date_format(d, order[0]), mark, F.date_format(d, order[1]), mark, F.date_format(d, "yyyy"))

        return F.when(found[0].isNotNull(), _day(found[0], key, written(("dd", "MM")))).otherwise(_day(found[1], key, written(("MM", "dd"))))

    return let(F.split(m, "[./]"), of)


def _email(m: Column, key: str) -> Column:
    """The name is permuted, letters as letters and digits as digits; the host stays. A name without any is none."""
    name = F.regexp_extract(m, "^([^@]*)@", 1)
    return F.when(m.rlike("^[^@]*[A-Za-z0-9]"), F.concat(let(let(bare(name), lambda n: feistel(_codes(n, _plain), "email", key)), lambda s: laid_out(name, s)), F.regexp_extract(m, "(@.*)$", 1)))


_PART = "struct<kind:string,new:string>"


def _plain_part(text: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), text.alias("new"))


def _ends(m: Column) -> Column:
    """The lengths of m after which no letter or digit follows, longest first."""
    at = F.sequence(F.length(m), F.lit(1), F.lit(-1))
    return F.filter(at, lambda e: F.substring(m, e, F.lit(1)).rlike("[0-9A-Za-z]") & ~F.substring(m, e + 1, F.lit(1)).rlike("[0-9A-Za-z]"))


def _number(m: Column, before: Column, key: str) -> Column:
    """kind, new and n (its length) of the longest valid card or IBAN at the start of a candidate; null without one. before: the text up to the candidate.

    What has the form of an IBAN and its country's length, but fails the check, is one part without a kind: its digits are no card. A card's groups but the last have four digits or more, with one kind of mark between them, or else it is a whole run of digits. After a plus sign, where phone numbers have up to 15 digits, it has more.
    """
    alone = ~F.coalesce(before, F.lit("")).rlike("[0-9][ -]$")
    plus = F.coalesce(before, F.lit("")).rlike("[+]$")

    def card_at(e: Column) -> Column:
        part, digits = F.substring(m, F.lit(1), e), F.length(bare(F.substring(m, F.lit(1), e)))
        whole = alone & ~F.substring(m, e + 1, F.length(m)).rlike("[0-9]|^[A-Za-z]")
        fine = digits.between(13, 19) & (part.rlike(_CARD_LAYOUT) | (whole & part.rlike("^[0-9 -]+$"))) & (~plus | (digits > 15))
        return F.struct(F.lit("card").alias("kind"), F.when(fine, _card(part, key)).alias("new"), e.alias("n"))

    def iban_at(e: Column) -> Column:
        part = F.substring(m, F.lit(1), e)
        own = (F.instr(F.lit(IBAN_LENGTHS), F.concat(F.substring(m, 1, 2), F.length(bare(part)).cast("string"))) > 0) & part.rlike(_IBAN_LAYOUT)

        def settled(v: Column) -> Column:
            return F.struct(F.when(v.isNotNull(), F.lit("iban")).alias("kind"), F.coalesce(v, F.when(own, part)).alias("new"), e.alias("n"))

        return let(F.when(own, _iban(part, key)), settled)

    found = lambda tried: F.get(F.filter(tried, lambda x: x["new"].isNotNull()), F.lit(0))
    return F.when(m.rlike("^[0-9]"), found(F.transform(_ends(m), card_at))).otherwise(found(F.transform(_ends(m), iban_at)))


def numbers(t: Column, key: str) -> Column:
    """t as parts (kind, new), in order: its valid cards and IBANs, from left to right (of overlapping ones, the rest of the later one is a part of its own), and between them plain text with a null kind."""

    def from_pieces(x: Column) -> Column:
        # pieces[i] starts with candidate i; what stands before the first candidate is kept apart
        ahead = F.when(F.size(x["p"]) > F.size(x["c"]), F.get(x["p"], F.lit(0))).otherwise(F.lit(""))
        pieces = F.when(F.size(x["p"]) > F.size(x["c"]), F.slice(x["p"], F.lit(2), F.greatest(F.size(x["p"]) - 1, F.lit(0)))).otherwise(x["p"])
        return let(F.struct(ahead.alias("ahead"), pieces.alias("p"), x["c"].alias("c")), valid)

    def valid(x: Column) -> Column:
        found = F.transform(x["c"], lambda m, i: _number(m, F.when(i == 0, x["ahead"]).otherwise(F.get(x["p"], i - 1)), key))
        return let(F.struct(x["ahead"].alias("ahead"), x["p"].alias("p"), found.alias("f")), segments)

    def segments(x: Column) -> Column:
        """The text before the first valid candidate, and for each one the text up to the next."""
        at = F.filter(F.sequence(F.lit(1), F.size(x["f"])), lambda i: F.element_at(x["f"], i).isNotNull())

        def cut(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(x["p"]) + 1)
            each = F.transform(at, lambda v, j: F.struct(F.element_at(x["f"], v).alias("v"), F.array_join(F.slice(x["p"], v, end(j) - v), "").alias("s")))
            return F.struct(F.concat(x["ahead"], F.array_join(F.slice(x["p"], F.lit(1), F.get(at, F.lit(0)) - 1), "")).alias("ahead"), each.alias("each"))

        return F.when(F.size(at) > 0, let(let(at, cut), folded)).otherwise(F.array(_plain_part(t)))

    def folded(x: Column) -> Column:
        def add(acc: Column, y: Column) -> Column:
            s, v, skip = y["s"], y["v"], acc["skip"]
            # what overlaps the one before it gives the end of its pseudonym, so that no digit of a valid number stays
            over = (skip > 0) & (v["n"] > skip) & v["kind"].isNotNull()
            n = F.when((skip == 0) | over, v["n"]).otherwise(skip)
            new = F.when((skip == 0) | over, F.array(F.struct(v["kind"].alias("kind"), F.substring(v["new"], skip + 1, F.length(v["new"])).alias("new")))).otherwise(F.array().cast(f"array<{_PART}>"))
            rest = F.when(n < F.length(s), F.array(_plain_part(F.substring(s, n + 1, F.length(s))))).otherwise(F.array().cast(f"array<{_PART}>"))
            return F.struct(F.greatest(n - F.length(s), F.lit(0)).cast("int").alias("skip"), F.concat(acc["parts"], new, rest).alias("parts"))

        start = F.struct(F.lit(0).alias("skip"), F.array(_plain_part(x["ahead"])).cast(f"array<{_PART}>").alias("parts"))
        return F.aggregate(x["each"], start, add, lambda acc: acc["parts"])

    found = let(F.struct(F.split(t, NUMBER, -1).alias("p"), F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1)).alias("c")), from_pieces)
    return F.when(t.rlike(NUMBER), found).otherwise(F.array(_plain_part(t)))


def pseudonym(m: Column, key: str) -> Column:
    """kind and new value of a match of PATTERN; where validation fails, a null kind and the match itself."""
    makers = {"email": _email, "secret": lambda m, key: feistel(_codes(m, _hex), "secret", key), "ip": _ip, "phone": _phone, "ssn": _ssn, "iso date": _iso_date, "date": _date}

    def settled(name: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.when(v.isNotNull(), F.lit(name.split()[-1])).alias("kind"), F.coalesce(v, m).alias("new"))

    new = None
    for name, (_, form, _) in FORMS.items():
        new = (F if new is None else new).when(m.rlike(f"^(?:{form})$"), let(makers[name](m, key), settled(name)))
    return new.otherwise(_plain_part(m))


def others(t: Column, key: str) -> Column:
    """t as parts (kind, new), in order: what PATTERN finds, and the text between."""
    between = F.split(t, PATTERN, -1)
    made = F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key))
    both = F.flatten(F.zip_with(between, made, lambda p, m: F.when(m.isNull(), F.array(_plain_part(p))).otherwise(F.array(_plain_part(p), m))))
    return F.when(t.rlike(PATTERN), both).otherwise(F.array(_plain_part(t)))


def session_key(docs: DataFrame) -> str | None:
    return docs.sparkSession.conf.get(KEY_SETTING, None)


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with text pseudonymised, and with n_pii (long) and pii (array of struct kind, value: the pseudonyms in order).

    Handled: e-mail names, IBAN (mod 97), IPv4 addresses, phone numbers with a country code (8 to 15 digits), US social security numbers,
    calendar dates from 1700 to 2099, card numbers of 13 to 19 digits (Luhn) and quoted hexadecimal secrets. Numbers that fail their
    check stay as they are; IBANs are those of the public registry's countries and lengths. Cards and IBANs are tried at every start of a group of digits or letters, whatever stands before or behind, from left to right and the longest first; a card's groups but the last have four digits or
    more and one kind of mark between them, or else a run of digits is one as a whole. Where two valid ones overlap, the rest of the later one goes too, as a part of its own.
    key: by default the session's spark.reachway.pii.key; without either this raises, since pseudonyms by a known key can be inverted.

    A null text stays null, with no pseudonyms; an empty one stays empty; an empty table gives an empty table. Texts of any length are searched as a whole, in time that grows with their length. Input columns called
    n_pii or pii are replaced. One narrow pass without a shuffle or Python; rows are handled on their own, so that repeated rows stay
    repeated. A value whose pseudonym happens to equal itself counts as replaced.
    """
    key = session_key(docs) if key is None else key
    if not key:
        raise ValueError(f"no key: pass one or set {KEY_SETTING}")
    t = F.col(f"`{text}`")
    parts = F.flatten(F.transform(numbers(t, key), lambda p: F.when(p["kind"].isNull(), others(p["new"], key)).otherwise(F.array(p))))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"), F.when(t.rlike(_HINT), parts).alias("parts"))
    whole = F.when(F.col("parts").isNull(), F.col("t")).otherwise(F.array_join(F.transform("parts", lambda p: p["new"]), ""))
    valid = F.transform(F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["new"].alias("value")))
    valid = F.coalesce(valid, F.array().cast("array<struct<kind:string,value:string>>"))
    names = [c for c in docs.columns if c.lower() not in ("n_pii", "pii")]
    return row.select(*[(whole if c == text else F.col(f"row.`{c}`")).alias(c) for c in names], F.size(valid).cast("long").alias("n_pii"), valid.alias("pii"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, text (pseudonymised), n_pii, kinds (comma-separated, in order). By the session's key, or else the public KEY."""
    return pseudonymise(docs.select("doc_id", "text"), session_key(docs) or KEY).select("doc_id", "text", "n_pii", F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"))
