"""Nearest points among more targets than a worker holds: a quadtree's leaves of bounded count, and bounds on distances that say which leaves a point must see.

Targets are sorted along a space-filling curve by range, and each task splits its stretch into quadtree cells until a cell has at most `leaf` of them; a leaf is one packed row with the box of
its targets. The boxes alone (their number is bounded) go to all workers. A point first meets the leaf nearest to it, which bounds its k-th distance, and then only the leaves whose boxes are within that bound.
However crowded a place is, its leaves are many and small; points that crowd around one leaf are dealt in chunks, with a copy of the leaf for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Targets of a leaf at most, leaves in all about (larger leaves beyond that), points that meet a leaf in one task, and levels of the quadtree.
LEAF, LEAVES, POINTS, LEVELS = 2_048, 100_000, 100_000, 26
#: Boxes that are looked at as one first, and points that are looked at together.
GROUP, BATCH = 64, 2_000
_LEAF = "leaf long, x0 double, x1 double, y0 double, y1 double, n long, ids binary, xs binary, ys binary"
_LEAF_ARROW = pa.schema([("leaf", pa.int64()), *[(c, pa.float64()) for c in ("x0", "x1", "y0", "y1")], ("n", pa.int64()), *[(c, pa.binary()) for c in ("ids", "xs", "ys")]])


def curve(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The place of each point on the Z-order curve of 2**LEVELS cells a side over box (x0, x1, y0, y1)."""
    out = np.zeros(len(x), np.int64)
    for v, low, high, shift in ((x, box[0], box[1], 0), (y, box[2], box[3], 1)):
        c = np.clip((v - low) / max(high - low, 1e-300) * (1 << LEVELS), 0, (1 << LEVELS) - 1).astype(np.int64)
        for bit in range(LEVELS):
            out |= (c >> bit & 1) << (2 * bit + shift)
    return out


def cells(codes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Stretches of sorted codes that are quadtree cells of at most `limit` of them; where the finest cell has more, several stretches make it up."""
    out, stack = [], [(0, len(codes), LEVELS)]
    while stack:
        a, b, level = stack.pop()
        if b - a <= limit or level == 0:
            out += [(i, min(b, i + limit)) for i in range(a, b, limit)]
            continue
        quarter = codes[a:b] >> 2 * (level - 1)
        cuts = [a, *(a + np.flatnonzero(np.diff(quarter)) + 1).tolist(), b]
        stack += [(c, d, level - 1) for c, d in zip(cuts, cuts[1:], strict=False)]
    return sorted(out)


def _leaves(limit: int, box: tuple[float, float, float, float]):
    """Rows (id, x, y) of one stretch of the curve to packed leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        ids, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        codes = curve(x, y, box)
        order = np.argsort(codes, kind="stable")
        ids, x, y, codes = ids[order], x[order], y[order], codes[order]
        for a, b in cells(codes, limit):
            px, py = x[a:b], y[a:b]
            one = [0, px.min(), px.max(), py.min(), py.max(), b - a, ids[a:b].astype(np.int64).tobytes(), px.tobytes(), py.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, _LEAF_ARROW, strict=True)], schema=_LEAF_ARROW)

    return run


class Boxes:
    """The leaves' boxes, in the order of their numbers."""

    def __init__(self, leaf: np.ndarray, box: np.ndarray, n: np.ndarray):
        self.leaf, self.box, self.n = leaf, box, n
        starts = np.arange(0, len(leaf), GROUP)
        self.group = np.stack([(np.maximum if i % 2 else np.minimum).reduceat(box[:, i], starts) for i in range(4)], 1) if len(leaf) else box
        self.total = np.add.reduceat(n, starts) if len(leaf) else n

    @staticmethod
    def _gap(box: np.ndarray, x: np.ndarray, y: np.ndarray, far: bool) -> np.ndarray:
        """Squared distances from points to the nearest (or farthest) place of boxes, paired by broadcasting."""
        if far:
            dx, dy = np.maximum(x - box[..., 0], box[..., 1] - x), np.maximum(y - box[..., 2], box[..., 3] - y)
        else:
            dx, dy = np.maximum(np.maximum(box[..., 0] - x, x - box[..., 1]), 0), np.maximum(np.maximum(box[..., 2] - y, y - box[..., 3]), 0)
        return dx * dx + dy * dy

    def _within(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a point, place of a leaf) within each point's squared bound."""
        p, g = np.nonzero(self._gap(self.group[None], x[:, None], y[:, None], False) <= bound[:, None])
        leaf = g[:, None] * GROUP + np.arange(GROUP)
        ok = leaf < len(self.leaf)
        p, leaf = np.broadcast_to(p[:, None], leaf.shape)[ok], leaf[ok]
        near = self._gap(self.box[leaf], x[p], y[p], False) <= bound[p]
        return p[near], leaf[near]

    def bound(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each point has k targets: groups of leaves from the nearest on, by their farthest places, until they hold so many."""
        far = self._gap(self.group[None], x[:, None], y[:, None], True)
        order = np.argsort(far, 1)
        enough = np.argmax(np.cumsum(self.total[order], 1) >= k, 1)
        found = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
        return np.where(self.total.sum() >= k, found, np.inf)

    def home(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of the leaf nearest to each point; of several around it the one whose farthest place is nearest."""
        p, leaf = self._within(x, y, self.bound(x, y, 1))
        near, far = (self._gap(self.box[leaf], x[p], y[p], f) for f in (False, True))
        order = np.lexsort((far, near, p))
        return leaf[order][np.searchsorted(p[order], np.arange(len(x)))]

    def others(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, leaf = self._within(x, y, bound)
        keep = leaf != home[p]
        return p[keep], leaf[keep]


def _homes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        for b in batches:
            ids, x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for i in range(0, len(ids), BATCH):
                s = slice(i, i + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[s], x[s], y[s], boxes.leaf[boxes.home(x[s], y[s])])], names=["id", "x", "y", "leaf"])

    return run


def _others(shared, k: int):
    """Rows (id, x, y, home, reach: the k-th distance in the home leaf, or null) to (id, x, y, leaf) of the other leaves to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        place = {int(v): i for i, v in enumerate(boxes.leaf)}
        for b in batches:
            ids, x, y, home, reach = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for i in range(0, len(ids), BATCH):
                px, py, r = x[i : i + BATCH], y[i : i + BATCH], reach[i : i + BATCH].astype(float)
                bound = np.where(np.isnan(r), np.inf, r * r * (1 + 1e-9) + 1e-300)
                open_ = ~np.isfinite(bound)
                if open_.any():
                    bound[open_] = boxes.bound(px[open_], py[open_], k) * (1 + 1e-9) + 1e-300
                p, leaf = boxes.others(px, py, bound, np.array([place[int(h)] for h in home[i : i + BATCH]]))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[i : i + BATCH][p], px[p], py[p], boxes.leaf[leaf])], names=["id", "x", "y", "leaf"])

    return run


def nearest_in(ids: np.ndarray, tx: np.ndarray, ty: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point ids, target ids and distances of the k nearest of a leaf's targets (sorted by id, so that ties go to the least), some points at a time."""
    out = []
    for i in range(0, len(own), 256):
        o, d = own[i : i + 256], (tx - x[i : i + 256, None]) ** 2 + (ty - y[i : i + 256, None]) ** 2
        if skip_self:
            d = np.where(ids == o[:, None], np.inf, d)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, best, 1)
        has = np.isfinite(near)
        out.append((np.repeat(o, has.sum(1)), ids[best[has]], np.sqrt(near[has])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _meeting(k: int, skip_self: bool):
    def meet(points, leaf):
        import pandas as pd

        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = none
        if len(points) and len(leaf):
            ids, tx, ty = (np.frombuffer(leaf.iloc[0][c], t) for c, t in (("ids", np.int64), ("xs", float), ("ys", float)))
            order = np.argsort(ids, kind="stable")
            found = nearest_in(ids[order], tx[order], ty[order], points["id"].to_numpy(np.int64), points["x"].to_numpy(float), points["y"].to_numpy(float), k, skip_self)
        return pd.DataFrame(dict(zip(("id", "target", "dist"), found, strict=True)))

    return meet


def _met(pairs: DataFrame, leaves: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """id, target, dist: the k nearest targets of each pair's leaf. Pairs of one leaf are dealt in chunks of about POINTS."""
    chunks = pairs.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(POINTS)).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id", "x", "y"), F.col("chunks")).cast("int"))
    copies = leaves.select("leaf", "ids", "xs", "ys").join(chunks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "ids", "xs", "ys")
    both = dealt.select("id", "x", "y", "leaf", "chunk").groupBy("leaf", "chunk").cogroup(copies.groupBy("leaf", "chunk"))
    return both.applyInPandas(_meeting(k, skip_self), "id long, target long, dist double")


def nearest_by_leaves(points: DataFrame, targets: DataFrame, n: int, k: int, skip_self: bool, leaf: int = LEAF) -> DataFrame:
    """id, rank (int), target, dist: the k nearest of n targets of each point, exactly, ties by the least id. points and targets: id (long), x, y (double), no nulls.

    Of targets at one place only the k of least id (one more with skip_self) can be among the nearest; the others are left out first.
    """
    spark = points.sparkSession
    place = Window.partitionBy("x", "y").orderBy("id")
    targets = targets.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k + int(skip_self)).drop("r")
    box = tuple(float(v) for v in targets.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    limit = max(leaf, -(-n // LEAVES))
    parts = max(1, min(-(-n // (limit * 64)), 10_000))
    code = F.pandas_udf(lambda x, y: __import__("pandas").Series(curve(x.to_numpy(float), y.to_numpy(float), box)), "long")
    sorted_targets = targets.withColumn("c", code("x", "y")).repartitionByRange(parts, "c", "id").select("id", "x", "y")
    leaves = sorted_targets.mapInArrow(_leaves(limit, box), _LEAF).withColumn("leaf", F.monotonically_increasing_id()).checkpoint()
    found = leaves.select("leaf", "x0", "x1", "y0", "y1", "n").orderBy("leaf").collect()  # bounded by LEAVES, about
    table = np.array([tuple(r)[1:5] for r in found], float).reshape(len(found), 4)
    shared = spark.sparkContext.broadcast(Boxes(np.array([r["leaf"] for r in found], np.int64), table, np.array([r["n"] for r in found], np.int64)))
    homes = points.mapInArrow(_homes(shared), "id long, x double, y double, leaf long").checkpoint()
    first = _met(homes, leaves, k, skip_self).checkpoint()
    reach = first.groupBy("id").agg(F.when(F.count("*") >= k, F.max("dist")).alias("reach"))
    asked = homes.withColumnRenamed("leaf", "home").join(reach, "id", "left").select("id", "x", "y", "home", "reach")
    more = _met(asked.mapInArrow(_others(shared, k + int(skip_self)), "id long, x double, y double, leaf long").checkpoint(), leaves, k, skip_self)
    best = Window.partitionBy("id").orderBy("dist", "target")
    return first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", F.col("rank").cast("int").alias("rank"), "target", "dist")
