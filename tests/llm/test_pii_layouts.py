from __future__ import annotations

from tests.llm.test_pii import card, luhn, masked


def test_phone_numbers_stay_linked_in_all_layouts(spark):
    out = masked(spark, ["+49 30 1234567", "+49301234567", "+4930 1234567", "+351 21 1234567", "+351211234567"])
    digits = ["".join(c for c in o[2][0] if c.isdigit()) for o in out]
    assert len(set(digits[:3])) == 1 and digits[0].startswith("49") and digits[3] == digits[4] and digits[3].startswith("351")


def test_cards_and_ibans_with_more_beside_them(spark):
    numbers = ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005"]
    digits = lambda x: "".join(c for c in x if c.isdigit())
    # a run that is a valid number as a whole stays one candidate
    cases = [(n, b, a) for n in numbers for b, a in [("", " 123"), ("", " 12/27"), ("123 ", ""), ("12 ", " 345")] if luhn(digits(b + n + a.partition("/")[0]))]
    assert len(cases) > 8
    iban = "BE68 5390 0754 7034"
    tails = ["", " FOR", " FROM ME", " 2024"]
    out = masked(spark, [f"pay {b}{n}{a} now" for n, b, a in cases] + [iban + x for x in tails])
    for (n, b, a), (text, kinds, values) in zip(cases, out, strict=False):
        want = card("".join(c for c in n if c.isdigit()))
        assert kinds == ["card"] and "".join(c for c in values[0] if c.isdigit()) == want and text == f"pay {b}{values[0]}{a} now"
    first = out[len(cases)]
    assert [o for o in out[len(cases) :]] == [(first[0] + x, ["iban"], first[2]) for x in tails]


def test_cards_and_ibans_behind_any_numbers_and_codes(spark):
    number = "4111 1111 1111 1111"
    before = ["row " + "123456 " * 6, " ".join(str(10 + i) for i in range(18)) + " ", " ".join(map(str, range(1, 23))) + " ", "9" * 60 + " ", "1234 " * 40, "12-34-56-78-90-12-34-56-78-90-12-34-56-78-90-12-34-56-"]
    want = card("4111111111111111")
    for b, (text, kinds, _) in zip(before, masked(spark, [b + number + " end" for b in before]), strict=True):
        assert number not in text and text.endswith(f"{want[:4]} {want[4:8]} {want[8:12]} {want[12:]} end") and kinds[-1] == "card", b
    bank = "GB82 WEST 1234 5698 7654 32"
    before = ["REF AB12 ", "AB12 CD34 ", "X ", "DE89 DE89 DE89 DE89 ", "", "AB12 4111 1111 1111 1111 "]
    for b, (text, kinds, _) in zip(before, masked(spark, [b + bank + " end" for b in before]), strict=True):
        assert bank not in text and number not in text and kinds == (["card"] if number in b else []) + ["iban"], b


def test_dates_and_ids_beside_cards_are_found(spark):
    out = masked(spark, ["20240115 123-45-6788 4111 1111 1111 1111 1990-02-28", "+49 30 1234567 4111111111111111"])
    assert out[0][1] == ["ssn", "card", "date"] and out[1][1] == ["phone", "card"]


def test_overlapping_numbers_leave_no_digits(spark):
    """6789 4111 1111 1111 happens to be valid, too."""
    ((text, kinds, values),) = masked(spark, ["123-45-6789 4111 1111 1111 1111 end"])
    want = card("4111111111111111")
    assert kinds == ["card", "card"] and values[1] == " " + want[12:] and text.endswith(want[12:] + " end")
