from __future__ import annotations

import os

import pytest

import corpus_pipeline
from reachway.llm import queries
from reachway.llm.decontaminate import tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_brute_force(spark, tmp_path):
    from tests.llm.test_decontaminate import coverage
    from tests.llm.test_line_dedup import brute
    from tests.llm.test_simhash import classes, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs)
    for d in kept[:-1]:
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pairs = [[(r.doc_id, r.text) for r in d.orderBy("doc_id").collect()] for d in kept[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {i for i, _ in pairs[0]}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in first for i in good) >= 0.95 * len(good)
    assert [(str(i), t) for i, t in pairs[1]] == sorted([(i, t) for i, t, _, _ in brute(pairs[0], 10)], key=lambda x: int(x[0]))
    ids, texts = zip(*pairs[1], strict=True)
    sets, keys = [frozenset(shingles(t, 5)) for t in texts], [" ".join(shingles(t, 1)) for t in texts]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if keys[a] == keys[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    assert [i for i, _ in pairs[2]] == sorted(set(classes(len(ids), links, ids).values()))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fives = lambda t: set(zip(*(tokens(t)[k:] for k in range(5)), strict=False))
    seeds = [fives(x) for x in items]
    bad = {i for i, t in pairs[2] for shared in [fives(t)] for x, own in zip(items, seeds, strict=True) if own & shared and coverage(x, t) >= 0.6}
    assert [i for i, _ in pairs[3]] == [i for i, _ in pairs[2] if i not in bad] and bad
    assert {r.doc_id for r in kept[4].select("doc_id").distinct().collect()} == {i for i, _ in pairs[3]}


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count()


def test_one_query_for_each_operator():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.oracle_sql()) < set(names)
