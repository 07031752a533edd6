"""Corpus-wide line deduplication: lines that many documents share are dropped everywhere.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted per hash with map-side partial sums; lines
whose count reaches the threshold are dropped and each document is put together again by line position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import SPACE, prepare, row_key

#: Frequent line keys up to this many (16 bytes each) are broadcast; more of them are joined by a salted shuffle.
BROADCAST_KEYS = 500_000
#: Salts of the shuffle join, so that a line that a third of all rows share goes to as many tasks.
SALTS = 32
#: Ids that stand in several rows, up to this many (16 bytes each), are broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 500_000
_LINES = "k1 long, k2 long, again boolean, pos int, h1 long, h2 long, first int"
_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("again", pa.bool_()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int32())])
_STRIP = SPACE.encode()
#: Lines of one Arrow batch that goes back to Spark.
_BATCH = 65_536


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def explode_lines(min_chars: int):
    """Rows (k1, k2, again, text) to one row for each line with a key of at least min_chars code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[] for _ in _SCHEMA]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
            for c in out:
                c.clear()
            return batch

        for b in batches:
            for k1, k2, again, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                seen = set()
                for pos, line in enumerate((text or "").encode().lower().split(b"\n")):  # bytes.lower() is ASCII only
                    key = line.strip(_STRIP)
                    if len(key) < min_chars or (min_chars > 1 and len(key.decode()) < min_chars):
                        continue
                    h = xxhash.xxh3_128_intdigest(key)
                    for c, v in zip(out, (k1, k2, again, pos, _signed(h >> 64), _signed(h & (1 << 64) - 1), int(h not in seen)), strict=True):
                        c.append(v)
                    seen.add(h)
                if len(out[0]) >= _BATCH:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def _without(text, drops):
    """text without its lines at these positions; null where drops is null."""
    import pandas as pd

    def one(t, d):
        if d is None:
            return None
        gone = set(map(int, d))
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([one(t, d) for t, d in zip(text, drops, strict=True)], dtype=object)


def repeated_ids(ids: DataFrame) -> DataFrame:
    """d1, d2: hashes of the ids that several rows have; null is no id."""
    d1, d2 = row_key(F.col("id"))
    return ids.filter("id IS NOT NULL").select(d1.alias("d1"), d2.alias("d2")).groupBy("d1", "d2").count().filter("count > 1").select("d1", "d2").checkpoint()


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id", broadcast_keys: int = BROADCAST_KEYS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs with its text column less the lines that at least min_docs documents share, and with n_lines and n_dropped (long).

    A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased. Documents are counted by id: rows that share an id are one document,
    a row without an id is a document of its own. Every row gives a row, so that repeated rows stay repeated. A null text is an empty one: one empty line, kept. Keys under min_chars
    code points (at least 1) are kept. An empty table gives an empty table. Texts of any length are split as a whole; memory: one text and its lines' hashes. Input columns called n_lines or n_dropped are
    replaced; all others are kept as they are.

    Where ids aren't repeated a document is a row, and partial sums count them. Only lines of rows with repeated ids are made distinct by id first.
    """
    prepare(docs.sparkSession)
    min_chars = max(1, min_chars)
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # rows are keyed by id and text: rows that are equal in both have the same lines
    k1, k2 = row_key(F.col(f"`{doc_id}`"), full)
    again = repeated_ids(docs.select(F.col(f"`{doc_id}`").alias("id")))
    many = again.count()
    d1, d2 = row_key(F.col(f"`{doc_id}`"))
    slim = docs.select(k1.alias("k1"), k2.alias("k2"), d1.alias("d1"), d2.alias("d2"), full.alias("t"))
    if many:
        marks = again.withColumn("again", F.lit(True))
        slim = slim.join(F.broadcast(marks) if many <= broadcast_ids else marks, ["d1", "d2"], "left").select("k1", "k2", F.when(F.col("again"), F.col("d1")).alias("d1"), F.coalesce("again", F.lit(False)).alias("again"), "t")
    else:
        slim = slim.select("k1", "k2", F.lit(None).cast("long").alias("d1"), F.lit(False).alias("again"), "t")
    lines = slim.select("k1", "k2", "again", "t").mapInArrow(explode_lines(min_chars), _LINES)
    counted = lines.filter("NOT again").select("h1", "h2", "first")
    if many:
        own = slim.filter("again").select(F.col("d1").alias("k1"), "k2", "again", "t").mapInArrow(explode_lines(min_chars), _LINES)
        counted = counted.unionByName(own.select("k1", "h1", "h2").distinct().select("h1", "h2", F.lit(1).alias("first")))
    common = counted.groupBy("h1", "h2").agg(F.sum("first").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2").checkpoint()
    if common.count() <= broadcast_keys:
        hits = lines.join(F.broadcast(common), ["h1", "h2"])
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod(F.hash("k1", "pos"), F.lit(SALTS))).join(salted, ["h1", "h2", "salt"])
    drops = hits.groupBy("k1", "k2").agg(F.collect_set("pos").alias("drops"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), full.alias("t"), k1.alias("k1"), k2.alias("k2"))
    both = left.join(drops, ["k1", "k2"], "left")
    without = F.pandas_udf(_without, "string")
    kept: Column = F.coalesce(without(F.when(F.col("drops").isNotNull(), F.col("t")), F.col("drops")), F.col("t"))
    n_lines = (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return both.select(
        *[kept.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names],
        n_lines.alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_common_lines(docs.select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT r, doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), k AS (
  SELECT r, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce('id ' || doc_id, 'row ' || r)) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
"""
