"""Resampling towards a target distribution by importance weights over hashed word runs.

A scan of a text keeps the running CRC-32 states of the runs that began at the last `order` words, oldest first. Each word extends every state by a space and itself, the state of the longest
run leaves the ring, and a new one starts; all states after a word are the checksums of the runs that end there, and no run is ever put together. Buckets are checksums modulo their number.
Counts by bucket are summed within tasks first. The weight of a text is the floored mean of its buckets' log ratios of target and source; with Gumbel noise by document id added, the highest
scores are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare, without

#: Words of UTF-8 bytes: digits, a-z (texts are lower-cased first) and all characters beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ORDER, BUCKETS = 2, 10_000
#: Weights are in thousandths of a nat.
SCALE = 1000
#: Per cent of the documents with MIN_WORDS words or more that are drawn, and the seed of the noise.
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Checksums that are held before they are counted.
HELD = 2_000_000
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _SCORED.split(", ")])


def checksums(text: str | None, order: int = ORDER) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every run of 1 to `order` words joined by a space, in the order of their last words (longest first)."""
    ring: list[int] = []
    out: list[int] = []
    words = WORDS.findall((text or "").encode("utf-8", "replace").lower())
    for word in words:
        longer = b" " + word
        if len(ring) == order:
            del ring[0]
        ring = [crc32(longer, state) for state in ring]
        ring.append(crc32(word))
        out += ring
    return len(words), out


def _counted(order: int, buckets: int):
    """Texts to (bucket, n), one row a task for each bucket that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(buckets, np.int64), []

        def settle() -> None:
            counts[:] += np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
            held.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                held += checksums(text, order)[1]
                if len(held) >= HELD:
                    settle()
        settle()
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n (long): how many runs of 1 to `order` words of all texts fall into each bucket; buckets without any are left out. Null and empty texts have no runs."""
    prepare(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(_counted(order, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(SCALE * ln of the ratio of the bucket's shares in target and source), each bucket counted once more than it occurs."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return [math.floor(SCALE * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-SCALE * ln(-ln u)), u in (0, 1) by the seed and the id; a null id has an empty name."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(gain: np.ndarray, order: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, found = checksums(text, order)
                weight = int(gain[np.array(found, np.int64) % len(gain)].sum()) // len(found) if found else 0
                rows.append((doc_id, words, len(found), weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], schema=_ARROW)

    return run


def importance(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score (long) of every row of docs (doc_id, text), repeated ones too; target has the column text.

    A null or empty text has no words: n_features and weight are 0, its score is the noise alone. Texts of any length are scanned whole. Ids are taken as long (a null one stays null, and all
    null ids share one noise). An empty target or empty docs count as nothing: all gains come from the one that every bucket has. Other columns are ignored.
    What reaches the driver is one count a bucket, and the gains go out as one array of that many numbers. Texts are scanned twice, which costs less than to keep four bytes a word.
    """
    prepare(docs.sparkSession)
    source, wanted = ({b: n for b, n in bucket_counts(x, order, buckets).collect()} for x in (docs, target))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(_weighed(np.array(gains(source, wanted, buckets), np.int64), order, seed), _SCORED)


def resampling_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (long) for every row of docs. rank counts from 1 by falling score, ties by the smaller doc_id (null last), over the floor(percent * N / 100) highest
    scores of the N rows with min_words words or more; it is null for all others. Repeated rows are documents of their own and take ranks of their own.

    Ranks come from a sort by range: a row's rank is its place in its partition plus what the partitions before hold, so that no task sees more than its range.
    """
    scored = importance(docs, target, order, buckets, seed).withColumn("able", F.col("n_words") >= min_words)
    by = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.checkpoint().repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect())
    drawn = percent * sum(r["able"] for r in sizes) // 100
    offsets, before = {}, 0
    for r in sizes:
        offsets[r["part"]], before = before, before + r["n"]
    if not offsets:
        return placed.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    start = F.element_at(F.create_map(*[F.lit(v) for kv in offsets.items() for v in kv]), part)
    rank = (start + place + 1).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is drawn. Rows that share an id go where one of them isn't drawn."""
    ranks = resampling_ranks(docs, target, **options)
    return without(docs, ranks.filter("rank IS NULL").select(F.col("doc_id").alias("gone")).distinct())


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The query: doc_id, n_features, weight, score, rank."""
    return resampling_ranks(docs, target)


#: The same over run strings, with CRC-32 by its table.
ORACLE = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), words AS (
  SELECT 0 AS side, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark
), runs AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS (
  SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, crc
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), summed AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals
), gain AS (
  SELECT bucket, CAST(floor({SCALE} * ln(CAST((t + 1) * (s_all + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (t_all + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM totals, summed
), weighed AS (
  SELECT r, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (r) WHERE side = 0
), placed AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= {MIN_WORDS} DESC, score DESC, doc_id NULLS LAST) AS p, count(*) FILTER (n_words >= {MIN_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= {PERCENT} * n // 100 THEN p END AS rank FROM placed
"""
