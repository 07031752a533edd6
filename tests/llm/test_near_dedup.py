from __future__ import annotations

import random

import pytest

from reachway.llm import near_dedup
from tests.llm.test_simhash import shingles


def similarity(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("cut", [False, True])
def test_every_copy_with_one_passage_more_or_less_is_found(spark, cut):
    rnd = random.Random(int(cut))
    texts, pairs = [], 0
    for n in (20, 40, 100, 400):
        for _ in range(15):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
            longer = [*words, *(f"w{rnd.randrange(10**9)}" for _ in range(int((n - 4) * rnd.choice([0.125, 0.25]))))]
            one, other = (" ".join(longer), " ".join(words)) if cut else (" ".join(words), " ".join(longer))
            assert 0.8 <= similarity(one, other) < 0.91
            texts += [(2 * pairs, one), (2 * pairs + 1, other)]
            pairs += 1
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicate_groups(df).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) == pairs and len(set(got.values())) == pairs
