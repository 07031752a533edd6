"""Geometry: UTM zones and projection as column expressions, boxes, rings, hulls, and a grid index for nearest points."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and the transverse Mercator series in the third flattening (Krüger, to the fourth order).
_A, _INVERSE_F, _K0, _FALSE_EAST, _FALSE_NORTH = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0
_N = 1 / (2 * _INVERSE_F - 1)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_E = math.sqrt((2 - 1 / _INVERSE_F) / _INVERSE_F)


def utm_zone_sql(lon: str) -> str:
    return f"(CAST(floor(({lon} + 180e0) / 6e0) AS INT) + 1)"


def utm_epsg_sql(lon: str, lat: str) -> str:
    return f"({utm_zone_sql(lon)} + CASE WHEN {lat} < 0 THEN 32700 ELSE 32600 END)"


def utm_sql(lon: str, lat: str, zone: str, south: str) -> tuple[str, str]:
    """SQL of east and north in metres; works in Spark and DuckDB alike. Inputs should be columns: they occur several times."""
    lam = f"radians({lon} - (({zone}) * 6e0 - 183e0))"
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {_E!r}e0 * atanh({_E!r}e0 * {s}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1e0 + {t} * {t}))"
    east = " + ".join([eta, *(f"{a!r} * cos({2 * j}e0 * {xi}) * sinh({2 * j}e0 * {eta})" for j, a in enumerate(_ALPHA, 1))])
    north = " + ".join([xi, *(f"{a!r} * sin({2 * j}e0 * {xi}) * cosh({2 * j}e0 * {eta})" for j, a in enumerate(_ALPHA, 1))])
    return f"({_FALSE_EAST!r} + {_K0 * _RADIUS!r} * ({east}))", f"(CASE WHEN {south} THEN {_FALSE_NORTH!r} ELSE 0.0 END + {_K0 * _RADIUS!r} * ({north}))"


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1 + F.when(lat < 0, 32700).otherwise(32600)).cast("int")


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """East and north in metres (Krüger series; a few nanometres from the exact projection within a zone)."""
    lam = F.radians(lon - (zone * 6.0 - 183.0))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _FALSE_EAST + _K0 * _RADIUS * east, F.when(south, _FALSE_NORTH).otherwise(0.0) + _K0 * _RADIUS * north


def in_box(lon: Column, lat: Column, box: Mapping[str, float]) -> Column:
    """Inside a closed box; null where a coordinate is null."""
    return lon.between(box["lon_min"], box["lon_max"]) & lat.between(box["lat_min"], box["lat_max"])


def ring_edges(rings: Column) -> Column:
    """The edges (array of struct x1, y1, x2, y2) of all rings (array of array of struct x, y; closed or not): outer rings, holes and further parts alike."""

    def edges(ring: Column) -> Column:
        def edge(p: Column, i: Column) -> Column:
            q = F.element_at(ring, F.when(i + 2 > F.size(ring), 1).otherwise(i + 2).cast("int"))
            return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

        return F.transform(ring, edge)

    return F.flatten(F.transform(rings, edges))


def edges_contain(edges: Column, lon: Column, lat: Column) -> Column:
    """Whether these edges hold a point in their interior by the even-odd rule: a ray to the east crosses them an odd number of times. Points on an edge are outside. Edges that don't reach
    the point's latitude may be left out."""

    def crosses(e: Column) -> Column:
        apart = (e["y1"] > lat) != (e["y2"] > lat)
        return F.when(apart, lon < e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))).otherwise(False)

    def touches(e: Column) -> Column:
        straight = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"]) == 0
        return straight & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0), lambda n: n % 2 == 1)
    return odd & ~F.exists(edges, touches)


def ring_contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether one ring (array of struct x, y; closed or not) holds a point in its interior."""
    return edges_contain(ring_edges(F.array(ring)), lon, lat)


def point_in_ring(x: float, y: float, ring: list[tuple[float, float]]) -> bool:
    return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def polygon_parts(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Rings as polygons: an outer ring and its holes each. A ring inside an odd number of others is a hole, of the smallest outer ring around it; rings don't cross, but may touch."""

    def middle(ring: list[tuple[float, float]]) -> tuple[float, float]:
        """A point inside: half-way across the ring at the height half-way between two corners' heights."""
        heights = sorted({y for _, y in ring})
        y = (heights[0] + heights[1]) / 2 if len(heights) > 1 else heights[0]
        cuts = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if (y1 > y) != (y2 > y))
        return ((cuts[0] + cuts[1]) / 2, y) if len(cuts) > 1 else ring[0]

    inner = [middle(r) for r in rings]
    around = [[j for j, other in enumerate(rings) if j != i and abs(area(other)) > abs(area(rings[i])) and point_in_ring(*inner[i], other)] for i in range(len(rings))]
    parts = {i: [rings[i]] for i in range(len(rings)) if len(around[i]) % 2 == 0}
    for i, outer in enumerate(around):
        if len(outer) % 2:
            parts[min((j for j in outer if j in parts), key=lambda j: abs(area(rings[j])))].append(rings[i])
    return list(parts.values())


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull counter-clockwise from the least point (monotone chain); collinear points leave the two ends."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(reversed(pts))


def area(ring: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def wkt(ring: list[tuple[float, float]]) -> str:
    """POLYGON, or LINESTRING or POINT where a hull has no area."""
    text = ", ".join(f"{x!r} {y!r}" for x, y in (ring + ring[:1] if len(ring) > 2 else ring))
    return f"{'POLYGON ((' if len(ring) > 2 else 'LINESTRING (' if len(ring) == 2 else 'POINT ('}{text}{'))' if len(ring) > 2 else ')'}"


class GridIndex:
    """Points in square cells, about two a cell, for exact nearest neighbours in numpy. Ties go to the least id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x, y = ids[order], x[order], y[order]
        self.x0, self.y0 = (x.min(), y.min()) if len(x) else (0.0, 0.0)
        wide, high = (max(np.ptp(x), 1e-12), max(np.ptp(y), 1e-12)) if len(x) else (1.0, 1.0)
        self.cell = max(math.sqrt(wide * high * 2 / max(1, len(x))), max(wide, high) / 4096)
        self.nx, self.ny = int(wide / self.cell) + 1, int(high / self.cell) + 1
        code = self._col(x, self.nx, self.x0) * self.ny + self._col(y, self.ny, self.y0)
        order = np.argsort(code, kind="stable")
        self.ids, self.x, self.y = ids[order], x[order], y[order]
        self.start = np.searchsorted(code[order], np.arange(self.nx * self.ny + 1))

    def _col(self, v: np.ndarray, n: int, origin: float) -> np.ndarray:
        return np.clip(((v - origin) / self.cell).astype(np.int64), 0, n - 1)

    def nearest(self, x: np.ndarray, y: np.ndarray, k: int = 1, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 where there are fewer) and squared distances of the k nearest points, by row; skip: an id to leave out for each row."""
        n = len(x)
        best_id, best_d = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
        if not len(self.ids) or not n:
            return best_id, best_d
        cx, cy = self._col(x, self.nx, self.x0), self._col(y, self.ny, self.y0)
        # a query outside the grid is that much farther from the cells' borders
        out = np.maximum.reduce([self.x0 - x, x - (self.x0 + self.nx * self.cell), self.y0 - y, y - (self.y0 + self.ny * self.cell), np.zeros(n)])
        todo, r = np.arange(n), 0
        while len(todo):
            for dx in range(-r, r + 1):
                span = range(-r, r + 1) if abs(dx) == r else (-r, r)
                for dy in span if r else (0,):
                    gx, gy = cx[todo] + dx, cy[todo] + dy
                    ok = np.flatnonzero((gx >= 0) & (gx < self.nx) & (gy >= 0) & (gy < self.ny))
                    cell = gx[ok] * self.ny + gy[ok]
                    lo, hi = self.start[cell], self.start[cell + 1]
                    while (m := lo < hi).any():
                        ok, lo, hi = ok[m], lo[m], hi[m]
                        q = todo[ok]
                        d = (self.x[lo] - x[q]) ** 2 + (self.y[lo] - y[q]) ** 2
                        i = self.ids[lo]
                        use = np.ones(len(q), bool) if skip is None else i != skip[q]
                        self._put(best_id, best_d, q[use], i[use], d[use], k)
                        lo = lo + 1
            reach = np.maximum(0, r * self.cell - out[todo]) if (out[todo] > 0).any() else np.full(len(todo), r * self.cell)
            full = r > max(self.nx, self.ny)
            todo = todo[~((best_d[todo, -1] < reach**2) | full)]
            r += 1
        return best_id, best_d

    @staticmethod
    def _put(best_id: np.ndarray, best_d: np.ndarray, q: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> None:
        worse = (d < best_d[q, -1]) | ((d == best_d[q, -1]) & (i < best_id[q, -1]))
        q, i, d = q[worse], i[worse], d[worse]
        if not len(q):
            return
        ids, ds = np.concatenate([best_id[q], i[:, None]], 1), np.concatenate([best_d[q], d[:, None]], 1)
        rank = np.lexsort((ids, ds), axis=1)[:, :k]
        best_id[q], best_d[q] = np.take_along_axis(ids, rank, 1), np.take_along_axis(ds, rank, 1)
