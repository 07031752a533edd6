"""GeoParquet: tables with a geometry column in well-known binary, read to lon and lat (points) or ring and rings (polygons), and written from them.

Both byte orders, and the Z, M and SRID marks of the ISO and extended forms are read; of a multipolygon, rings holds all rings. Spark's Parquet writer has no way to add the `geo` entry of the
footer: readers that insist on it need it added.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reachway.functions.geo import area, polygon_parts
from reachway.functions.workers import ready

# Geometry types and marks of the format.
_POINT, _POLYGON, _MULTIPOLYGON = 1, 3, 6
_HAS_Z, _HAS_M, _HAS_SRID = 0x80000000, 0x40000000, 0x20000000
_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_NEW = "lon double, lat double, ring array<struct<x:double,y:double>>, rings array<array<struct<x:double,y:double>>>"


def _shape(data: bytes, at: int) -> tuple[int, list, int]:
    """Type, content (a point, rings, or polygons' rings) and end of the geometry at this place."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 9 if code & _HAS_SRID else 5
    plain = code & 0x0FFFFFFF
    dims = 2 + bool(code & _HAS_Z) + bool(code & _HAS_M) + {0: 0, 1: 1, 2: 1, 3: 2}[plain // 1000]
    kind = plain % 1000
    if kind == _POINT:
        return kind, [struct.unpack_from(order + "2d", data, at)], at + 8 * dims
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    out: list = []
    for _ in range(n):
        if kind == _POLYGON:
            points = struct.unpack_from(order + "I", data, at)[0]
            flat = struct.unpack_from(f"{order}{dims * points}d", data, at + 4)
            out.append([(flat[dims * i], flat[dims * i + 1]) for i in range(points)])
            at += 4 + 8 * dims * points
        elif kind == _MULTIPOLYGON:
            _, rings, at = _shape(data, at)
            out += rings
        else:
            raise ValueError(f"geometries of type {kind} are not read")
    return kind, out, at


def decoded(data: bytes | None) -> tuple[float | None, float | None, list | None, list | None]:
    """lon, lat, the ring of largest area, and all rings."""
    if not data:
        return None, None, None, None
    kind, content, _ = _shape(data, 0)
    if kind == _POINT:
        x, y = content[0]
        return (None, None, None, None) if x != x else (x, y, None, None)  # an empty point is written as NaN
    return None, None, max(content, key=lambda r: abs(area(r)), default=None), content


def _polygon(rings: list[list]) -> bytes:
    closed = [r if r[0] == r[-1] else [*r, r[0]] for r in rings]
    return struct.pack("<B2I", 1, _POLYGON, len(closed)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in closed)


def encoded(lon: float | None, lat: float | None, rings: list | None) -> bytes | None:
    """A point, or else a polygon with its holes, or a multipolygon where rings make several parts; rings are closed if they aren't. Null without coordinates."""
    rings = [r for r in rings or () if r]
    if rings:
        parts = polygon_parts([r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings])
        return _polygon(parts[0]) if len(parts) == 1 else struct.pack("<B2I", 1, _MULTIPOLYGON, len(parts)) + b"".join(map(_polygon, parts))
    return None if lon is None or lat is None else struct.pack("<BI2d", 1, _POINT, lon, lat)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """The table's other columns, and lon, lat, ring, rings; columns of these names are replaced."""
    ready(spark)
    raw = spark.read.parquet(path)
    new = StructType.fromDDL(_NEW)
    kept = [f for f in raw.schema if f.name != geometry and f.name not in new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(decoded, b.column(0).to_pylist()), strict=True)) or [[], [], [], []]
            pairs = lambda ring: ring and [{"x": x, "y": y} for x, y in ring]
            made = [pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array([pairs(r) for r in cols[2]], _RING), pa.array([r and [pairs(x) for x in r] for r in cols[3]], pa.list_(_RING))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*b.schema.names[1:], *new.names])

    return raw.select(geometry, *[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType([*kept, *new.fields]))


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """df with its lon and lat, or its rings (or its one ring), as one column of well-known binary in the place of them."""
    ready(df.sparkSession)
    has = [c for c in ("lon", "lat", "ring", "rings") if c in df.columns]
    kept = [f for f in df.schema if f.name not in ("lon", "lat", "ring", "rings")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(i).to_pylist() for i, c in enumerate(has)}
            none = [None] * b.num_rows
            shapes = [all_ or (one and [one]) for all_, one in zip(at.get("rings", none), at.get("ring", none), strict=True)]
            rings = [shape and [[(p["x"], p["y"]) for p in r] for r in shape if r] for shape in shapes]
            made = [encoded(*x) for x in zip(at.get("lon", none), at.get("lat", none), rings, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[len(has) :], pa.array(made, pa.binary())], names=[*b.schema.names[len(has) :], geometry])

    schema = StructType([*kept]).add(geometry, "binary")
    df.select(*has, *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema).write.mode("overwrite").parquet(path)
