from __future__ import annotations

from reachway.llm import licenses

REF = "Licensed under the Apache License, Version 2.0. "


def test_many_sentences(spark):
    texts = [REF + "All rights reserved. " * 2_000, REF * 2_000, ("Released under the MIT License. " + REF) * 1_000, "all " * 30_000 + "rights.", "License. " + ". " * 30_000, "rights\n" * 30_000, "license " * 30_000]
    got = [r.rules for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [["apache-2.0-reference", "all-rights-reserved"], ["apache-2.0-reference"], ["apache-2.0-reference", "mit-reference"], [], [], [], []]


def test_rules_follow_the_order_of_sentences(spark):
    """By brute force: a rule matches where its identifiers are a subsequence."""
    import itertools

    ids = ["apache-ref", "apache-comply", "apache-copy", "apache-asis", "reserved"]
    rows = [(i, ". ".join(licenses.SENTENCES[k][0] for k in p) + ".") for i, p in enumerate(itertools.permutations(ids))]
    got = {r.doc_id: (r.sentence_ids, r.rules) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, p in enumerate(itertools.permutations(ids)):
        whole = [k for k in p if k != "reserved"] == ids[:4]
        assert got[i] == ("".join(f"<{k}>" for k in p), ["apache-2.0-header" if whole else "apache-2.0-reference", "all-rights-reserved"])
