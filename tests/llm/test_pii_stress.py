"""Texts that once crashed the JVM, leaked or were skipped by a prefilter."""

from __future__ import annotations

import re

import pytest

from reachway.llm import pii
from tests.llm.test_pii import card, masked

HEX = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6"
CARD = "4111 1111 1111 1111"


def test_long_chains_neither_crash_nor_take_long(spark):
    texts = ["x@" + "a." * 100_000, "x@" + "ab." * 20_000, "a" * 100_000, "a." * 50_000 + "@", "1 " * 10_000, "1" * 50_000, "@" * 30_000, '="' + "0f" * 10_000 + '"', "DE89 " * 10_000, "+1" * 20_000, "1.1." * 10_000, "a@b.co" * 5_000]
    out = masked(spark, texts)
    assert len(out) == len(texts) and out[2] == (texts[2], [], []) and out[5][0] == texts[5] and out[7][1] == ["secret"] and out[7][0] != texts[7]


def test_every_form_has_the_hint(spark):
    samples = ["john@example.com", f'key = "{HEX}"', "DE89370400440532013000", "1.2.3.4", "+1 504 555 2652", "123-45-6789", "1990-02-28", "2/8/1990", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    assert all(re.search(pii._HINT, x) for x in samples)
    assert all(len(o[1]) == 1 for o in masked(spark, samples)), samples


@pytest.mark.parametrize("before,after", [("", " 12 now"), ("order 123456 ", ""), ("invoice 20240115 ", " on 12-2024"), ("", " 5500 0000 0000 0004"), ("77 ", " 88")])
def test_cards_among_other_numbers(spark, before, after):
    ((text, kinds, _),) = masked(spark, [before + CARD + after])
    want = card("4111111111111111")
    assert f"{want[:4]} {want[4:8]} {want[8:12]} {want[12:]}" in text and CARD not in text and text.startswith(before)
    assert kinds == ["card"] * (2 if "0004" in after else 1)


def test_long_names_and_secrets_are_whole(spark):
    name, secret = "n" * 90 + "7.x", "0f" * 200
    out = masked(spark, [f"<{name}@example.com>", f"k: '{secret}'", "...@x.com a@b..com", "-jo@x.org, jo@x.org"])
    assert out[0][1] == ["email"] and "nnnn" not in out[0][0] and out[0][0].endswith("@example.com>")
    assert len(out[1][2][0]) == 400 and out[1][2][0] != secret
    assert out[2][0] == "...@x.com a@b..com" and out[3][1] == ["email", "email"]


def test_no_key_no_pseudonyms(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    with pytest.raises(ValueError, match="no key"):
        pii.pseudonymise(df)
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.pseudonymise(df).first().text == pii.pseudonymise(df, "mine").first().text != "a@b.com"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
