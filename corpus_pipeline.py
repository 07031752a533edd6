"""A corpus pipeline over the documents table: quality classifier, line dedup, near-dedup, benchmark decontamination, packing.

Each stage reads what the last one wrote. All but the last return the columns of documents, whatever these are called: columns of the names that an operator adds stay as they came.
Every row is handled on its own where a stage's docstring doesn't say otherwise; other columns are carried along. Each stage takes an empty table and then returns an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachway.llm import decontaminate, line_dedup, near_dedup, packing, quality
from reachway.llm.common import carried, prepare, remove, shared_dir, table

#: Documents under this score are rejected.
REJECT_UNDER = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores at REJECT_UNDER or more.

    Null and empty texts get the score of statistics that are all zero, like any other text; texts of any length are measured as a whole. Equal texts get equal scores, so that repeated rows
    stay or go together; a score of exactly REJECT_UNDER stays. Without labels the score is a constant of one half, and all rows stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    whole, back = carried(docs)
    return back(quality.scored(whole, model).filter(F.col("score") >= REJECT_UNDER))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that 10 documents or more share (rows with one id are one document); n_chars is counted anew where docs has it.

    A null text becomes an empty one. A document stays even where all its lines go. Texts of any length are split as a whole; repeated rows stay repeated.
    """
    whole, back = carried(docs)
    out = line_dedup.drop_common_lines(whole, min_docs=10, min_chars=1)
    counted = {c: F.length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return back(out, **counted)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of every group of near-duplicates (five-word shingles, similarity 0.8).

    Null and empty texts have no words and are equal to each other: one stays. Rows that share an id stay or go together, rows without an id stay. Of equal texts the least id stays, so that there are no ties.
    """
    return near_dedup.deduplicated(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (tiles of five words or more over 60 % of its words).

    Null and empty texts leak nothing. A leak takes all rows with its id along, a null id being an id like others. An empty benchmark drops nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; every row is a document, a null or empty text is its closing id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]
#: Boosted trees, near-duplicate components and packing have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again. What a stage has read goes once its own result is written; the last result stays, for the caller to read."""
    prepare(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
