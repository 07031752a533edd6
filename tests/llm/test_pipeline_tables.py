"""The stages over tables with nulls, empty and very long texts, repeated rows, clashing columns, and over empty tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import coverage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

GOOD = "The harbour master walked along the quiet pier in the morning. He counted {} boats and wrote their names down. Nobody else was there at that hour."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_lines int, n_dropped string, gone long, row string, t string, k1 long, carried_row string, item_ids string"
EXTRA = (99.0, 7, -5, "x", 4, "r", "t", 8, "c", "i")
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def docs(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = [(i, GOOD.format(i) + f" Story number {i} ended here, said {'abcdefghijklmnop'[i]}." * (i + 1)) for i in range(12)]
    texts += [(20, None), (21, ""), (22, "word " * 200_000), (23, texts[3][1]), (3, texts[3][1]), (None, texts[5][1]), (24, GOOD.format(77) + " " + bench), (25, "\n".join(["shared line"] * 3 + ["own one"]))]
    texts += [(30 + i, f"shared line\nand some words of text number {i} that no other text has, {i * i}") for i in range(11)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *EXTRA) for i, t in texts], SCHEMA).repartition(3)


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def untouched(df, but=()):
    for r in df.collect():
        assert tuple(r)[5:] == EXTRA and r.lang == "en" and r.source == "s"


def test_stages(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, docs, SF)
    assert kept.columns == NAMES and set(rows(kept)) <= set(rows(docs)) and kept.count()
    untouched(kept)
    lines = stage["line dedup"](spark, docs, SF)
    assert lines.columns == NAMES and lines.count() == docs.count()
    untouched(lines)
    by_id = {r.doc_id: r for r in lines.collect()}
    assert by_id[25].text == "own one" and by_id[25].n_chars == 7 and by_id[20].text == "" and "shared line" not in by_id[31].text and len(by_id[22].text) == 1_000_000
    near = stage["simhash near-dedup"](spark, docs, SF)
    assert near.columns == NAMES
    untouched(near)
    left = [r.doc_id for r in near.collect()]
    assert 20 in left and 21 not in left and 23 not in left and left.count(3) == 2 and None in left and 22 in left
    clean = stage["benchmark decontamination"](spark, docs, SF)
    assert clean.columns == NAMES
    untouched(clean)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in docs.filter("doc_id < 22 OR doc_id > 22").collect() if any(coverage(x, r.text) >= 0.6 for x in items)}
    assert bad == {24} and rows(clean) == [x for x in rows(docs) if x[0] != 24]
    packed = stage["packing"](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_tables_and_few_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs.limit(0), docs.limit(0).select("doc_id", "text")):
            out = stage(spark, df, SF)
            assert out.count() == 0 and (name == "packing" or out.columns == df.columns)
    slim = docs.select("text", "doc_id")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, slim, SF).columns == ["text", "doc_id"]


def test_folders_of_stages_go(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF)
    (new,) = [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]
    assert os.listdir(f"{folder}/{new}") == ["4"]
