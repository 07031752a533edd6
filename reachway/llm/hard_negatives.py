"""Hard negatives by exact inner-product search over candidates in buckets of falling norm.

All vectors are sorted by norm and cut into buckets; every 100th id is an anchor. Anchors go out in rounds of bounded size, in blocks, and each bucket meets each block as two matrices. A task
takes its buckets in the order of their norms: by the Cauchy-Schwarz inequality no score of a bucket exceeds the anchor's norm times the bucket's largest, so that anchors for which this
is below all that they still need are left out, and buckets that nothing needs are skipped. What an anchor needs is the lower limit of a window of scores, and the running k-th score
within it. The first search finds the positives (same label), the second the negatives of each positive's window (other labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachway.llm.common import prepare

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
#: Rows of a bucket, of an anchor block, and of a round of blocks (which bounds what is broadcast at once, and the state of a task).
BUCKET, BLOCK, ROUND = 4_096, 2_048, 65_536
#: Anchors whose scores are looked at together.
CHUNK = 256
#: Scores and bounds stay under this, so that sums of doubles are exact and a score and a place fit into 64 bits.
LIMIT = float(1 << 50)
NONE = np.iinfo(np.int64).min
_PACKED = "top double, width int, ids binary, labels binary, vectors binary, norms binary, scores binary, least binary"
_PACKED_ARROW = pa.schema([("top", pa.float64()), ("width", pa.int32()), *[(n, pa.binary()) for n in ("ids", "labels", "vectors", "norms", "scores", "least")]])
_FOUND = "anchor_id long, j int, other_id long, score long"
_FOUND_ARROW = pa.schema([("anchor_id", pa.int64()), ("j", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])


def _packed(size: int, windows: int):
    """Rows (id, label, vector[, scores of positives, least scores worth finding]) to rows of up to `size` of them, in the order in which they come and by id inside; vectors become whole numbers.
    windows: scores and least scores of a row, NONE where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            width = max(len(r[2]) for r in rows)
            v = np.zeros((len(rows), width))
            scores, least = (np.full((len(rows), windows), NONE, np.int64) for _ in range(2))
            for i, r in enumerate(rows):
                v[i, : len(r[2])] = np.floor(SCALE * r[2])
                for into, given in zip((scores, least), r[3:], strict=False):
                    into[i, : len(given)] = given
            norms = np.sqrt((v * v).sum(1))
            if norms.max(initial=0) >= LIMIT:
                raise ValueError("a vector's components are too large for exact scores")
            small = np.abs(v).max(initial=0) < 1 << 15
            one = [norms.max(initial=0), width, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), v.astype(np.int16) if small else v, norms, scores, least]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], f.type) for x, f in zip(one, _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)

        for b in batches:
            vectors = [np.array(x, np.float64) for x in b.column(2).to_pylist()]
            more = [[[NONE if v is None else v for v in x or ()] for x in c.to_pylist()] for c in b.columns[3:]]
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), vectors, *more, strict=True):
                rows.append(row)
                if len(rows) >= size:
                    yield close()
                    rows.clear()
        if rows:
            yield close()

    return run


class Packed:
    """The arrays of a packed row."""

    def __init__(self, width: int, ids: bytes, labels: bytes, vectors: bytes, norms: bytes, scores: bytes, least: bytes):
        self.ids, self.labels, self.norms = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(norms)
        n = len(self.ids)
        kind = np.int16 if len(vectors) == 2 * n * width and width else np.float64
        self.vectors = np.frombuffer(vectors, kind).astype(np.float64).reshape(n, width)
        self.scores, self.least = (np.frombuffer(x, np.int64).reshape(n, -1) for x in (scores, least))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products; the shorter vectors count as zero beyond their end."""
    w = min(a.shape[1], b.shape[1])
    return a[:, :w] @ b[:, :w].T


def best(scores: np.ndarray, mask: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with anything under the mask, and their k best scores and ids (ties: the first column; columns are sorted by id), NONE where there are fewer."""
    rows = np.flatnonzero(mask.any(1))
    n = scores.shape[1]
    key = np.where(mask[rows], scores[rows].astype(np.int64) * n + np.arange(n - 1, -1, -1), NONE)
    if n > k:
        key = np.partition(key, n - k, axis=1)[:, n - k :]
    fine = key != NONE
    place = n - 1 - key % n
    return rows, np.where(fine, key // n, NONE), np.where(fine, ids[place], NONE)


def merge(scores: np.ndarray, ids: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists a row, in order."""
    s, i = np.concatenate([scores, new_scores], -1), np.concatenate([ids, new_ids], -1)
    order = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=-1)[..., :k]
    return np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


class Search:
    """The running lists of one anchor block in one task: for each anchor and window the k best so far."""

    def __init__(self, block: Packed, k: int, windows: tuple[int, int] | None):
        self.block, self.k, self.same = block, k, windows is None
        n = len(block.ids)
        if windows is None:
            self.low, self.high = np.full((n, 1), -LIMIT), np.full((n, 1), LIMIT)
        else:
            p, none = np.where(block.scores == NONE, 0, block.scores), block.scores == NONE
            self.low, self.high = np.where(none, LIMIT, -((-windows[0] * p) // 100)), np.where(none, -LIMIT, (windows[1] * p) // 100)
        self.scores, self.ids = (np.full((n, self.low.shape[1], k), NONE, np.int64) for _ in range(2))

    def need(self) -> np.ndarray:
        """The least score that each anchor and window still takes; infinite for empty windows."""
        return np.where(self.low > self.high, np.inf, np.maximum(np.maximum(self.low, self.block.least), self.scores[:, :, -1]))

    def add(self, bucket: Packed, top: float) -> None:
        need = self.need()
        # a little more than the bound, for the rounding of roots
        left = np.flatnonzero((self.block.norms * top * (1 + 1e-12) + 1 >= need.min(1)) & np.isfinite(need.min(1)))
        for at in (left[i : i + CHUNK] for i in range(0, len(left), CHUNK)):
            s = _scores(self.block.vectors[at], bucket.vectors)
            fit = (self.block.labels[at][:, None] == bucket.labels) == self.same
            if self.same:
                fit &= self.block.ids[at][:, None] != bucket.ids
            for j in range(self.low.shape[1]):
                mask = fit & (s >= need[at, j, None]) & (s <= self.high[at, j, None])
                rows, scores, ids = best(s, mask, bucket.ids, self.k)
                own = at[rows]
                self.scores[own, j], self.ids[own, j] = merge(self.scores[own, j], self.ids[own, j], scores, ids, self.k)

    def rows(self) -> pa.RecordBatch:
        a, j, k = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.block.ids[a]), pa.array(j.astype(np.int32)), pa.array(self.ids[a, j, k]), pa.array(self.scores[a, j, k])], schema=_FOUND_ARROW)


def _searched(k: int, windows: tuple[int, int] | None):
    """Rows of a bucket (top, width, ids, labels, vectors) beside a block (number, and all of its columns) to what each task finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Search] = {}
        held, bucket = None, None
        for b in batches:
            for row in range(b.num_rows):
                top, width, ids, labels, vectors, norms, number = (b.column(i)[row].as_py() for i in range(7))
                if number not in found:
                    found[number] = Search(Packed(*(b.column(i)[row].as_py() for i in range(7, 14))), k, windows)
                if ids != held:
                    held, bucket = ids, Packed(width, ids, labels, vectors, norms, b"", b"")
                found[number].add(bucket, top)
        for s in found.values():
            yield s.rows()

    return run


def _blocks(anchors: DataFrame, n: int, windows: int) -> DataFrame:
    """anchors (id, label, vector, scores, least) packed in blocks, with their numbers."""
    parts = max(1, -(-n // BLOCK))
    packed = anchors.select("id", "label", "vector", "scores", "least").repartitionByRange(parts, "id").mapInArrow(_packed(BLOCK, windows), _PACKED)
    return packed.withColumn("number", F.monotonically_increasing_id()).checkpoint()


def _wave(buckets: DataFrame, blocks: DataFrame, k: int, windows: tuple[int, int] | None) -> DataFrame:
    """anchor_id, j, other_id, score: what each task finds, in rounds. The query set meets all buckets in blocks; a block's vectors are serialised once a bucket, which is
    little beside the products of both."""
    numbers = [r[0] for r in blocks.select("number").orderBy("number").collect()]
    out, step = None, max(1, ROUND // BLOCK)
    for i in range(0, len(numbers), step):
        own = blocks.filter(F.col("number").between(numbers[i], numbers[min(i + step, len(numbers)) - 1]))
        asked = F.broadcast(own.select("number", *[F.col(c).alias(f"q_{c}") for c in ("width", "ids", "labels", "vectors", "norms", "scores", "least")]))
        met = buckets.select("top", "width", "ids", "labels", "vectors", "norms").crossJoin(asked).mapInArrow(_searched(k, windows), _FOUND)
        met = met if len(numbers) <= step else met.checkpoint()
        out = met if out is None else out.unionByName(met)
    return out if out is not None else buckets.sparkSession.createDataFrame([], _FOUND)


def _search(buckets: DataFrame, anchors: DataFrame, n: int, k: int, windows: tuple[int, int] | None, width: int) -> DataFrame:
    """anchor_id, j, other_id, score, rank: the k best of each anchor (id, label, vector, scores) and window; width: windows of an anchor.

    A task would give k of each window, however many tasks there are. So every so many-th task's buckets are searched first: their k-th score is what the others must reach. With a wave of the
    root of all tasks both waves give about the root times k of each window.
    """
    none = F.array().cast("array<long>")
    blank = anchors.withColumn("least", none)
    blank = blank if "scores" in anchors.columns else blank.withColumn("scores", none)
    step = int(np.sqrt(buckets.rdd.getNumPartitions()))
    if step < 3:
        return _first(_wave(buckets, _blocks(blank, n, width), k, windows), k)
    dealt = buckets.withColumn("part", F.spark_partition_id())
    some = _first(_wave(dealt.filter(F.col("part") % step == 0), _blocks(blank, n, width), k, windows), k).checkpoint()
    least = some.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("m"))
    least = least.select("anchor_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.col("m")[j]).alias("found"))
    told = blank.join(least, F.col("id") == F.col("anchor_id"), "left").select("id", "label", "vector", "scores", F.coalesce("found", none).alias("least"))
    rest = _wave(dealt.filter(F.col("part") % step != 0), _blocks(told, n, width), k, windows)
    return _first(some.drop("rank").unionByName(rest), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their rank. A task gives k of a window at most; these are cut again before they move."""
    order = Window.partitionBy("anchor_id", "j").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (int), negative_id, positive_score, negative_score of the rows of vectors (vec_id, embedding, label); anchor says which of them are anchors.

    Components become floor(256 * x) in doubles, scores are whole inner products. The positives of an anchor are its `positives` best other rows of the same label; for each positive, the `negatives` best rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned, by falling score, ties by the smaller id; a pair without any has no rows.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of vectors of different lengths the shorter counts as zero beyond its end. Rows with one id are candidates of their own, so that an id may come
    more than once; no row is a positive of an anchor with its id, and of several anchors with one id the least by label and vector is taken. An empty table gives no rows; other columns are ignored. Norms beyond 2**25 can give
    scores beyond exact sums of doubles: products of norms from 2**50 on raise.
    """
    spark = prepare(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    own = own.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), anchor.alias("asks"))
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + F.pow(F.floor(SCALE * x).cast("double"), F.lit(2.0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.desc(norm), F.asc("id")]
    buckets = own.select("id", "label", "vector").repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_packed(BUCKET, 0), _PACKED).checkpoint()
    anchors = own.filter("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector").checkpoint()
    n = anchors.count()
    top = buckets.agg(F.max("top")).first()[0] or 0.0
    if top * top >= LIMIT:
        raise ValueError("vectors are too long for exact scores")
    near = _search(buckets, anchors, n, positives, None, 1).select("anchor_id", F.col("rank").alias("p"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint()
    listed = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("all"))
    asked = anchors.join(listed, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", F.col("all.positive_score").alias("scores"))
    found = _search(buckets, asked, n, negatives, (low, high), positives)
    named = found.join(near.withColumn("j", F.col("p") - 1), ["anchor_id", "j"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """The query: of every 7th id the label is moved by one (modulo 10) first; every 100th id is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= {NEGATIVES}
"""
