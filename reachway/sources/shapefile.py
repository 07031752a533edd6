"""Shapefiles as a Spark data source: `spark.read.format("shapefile").load(path)` of one file or a folder of parts, and `df.write.format("shapefile").save(folder)`.

A row for each record: the fields of the .dbf beside the .shp, and lon and lat (points) or ring (array of struct x, y: the outer ring of largest area) and rings
(all rings). Coordinates are taken as they are: the layers used here are in degrees. The .shx index, where there is one, splits the file among tasks.

Tasks write shapefiles of their own, of up to RECORDS_PER_TASK records (parts.py); columns but lon, lat, ring and rings become fields as text. What has rings (or a ring) is a polygon with its holes and parts, what has lon and lat a
point, else the shape is empty. Nulls are empty fields.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from reachway.functions.geo import area
from reachway.functions.workers import ready
from reachway.sources import encoders
from reachway.sources.parts import PartWriter, listed
from reachway.sources.paths import exists, opened, size

RECORDS_PER_TASK = 50_000
# Shape types of the format.
_POINTS, _POLYGONS = (1, 11, 21), (3, 5, 13, 15, 23, 25)


def _beside(path: str, ending: str) -> str | None:
    stem = path[:-4]
    return next((stem + e for e in (ending, ending.upper()) if exists(stem + e)), None)


def dbf_fields(f) -> tuple[list[tuple[str, str, int]], int, int, int]:
    """Fields (name, type, length), records, header length and record length of an open .dbf file."""
    head = f.read(32)
    count, length, width = struct.unpack("<IHH", head[4:12])
    fields = []
    for _ in range((length - 33) // 32):
        d = f.read(32)
        if d[:1] == b"\r":
            break
        fields.append((d[:11].split(b"\0")[0], chr(d[11]), d[16]))
    return fields, count, length, width


def _encoding(path: str) -> str:
    code = _beside(path, ".cpg")
    if code:
        with opened(code) as f:
            name = f.read().decode("ascii", "replace").strip().lower()
        return "utf-8" if name in ("utf-8", "utf8", "65001") else "latin-1" if "8859" in name or name in ("1252", "ansi 1252") else name or "utf-8"
    return "utf-8"


def _text(raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return raw.decode("latin-1")


def geometry(content: bytes):
    """(lon, lat, rings) of one record's content."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind in _POINTS:
        return (*struct.unpack("<2d", content[4:20]), None)
    if kind in _POLYGONS:
        parts, points = struct.unpack("<2i", content[36:44])
        starts = [*struct.unpack(f"<{parts}i", content[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", content[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        return None, None, [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    return None, None, None


def _files(path: str) -> list[str]:
    names = listed(path)
    return [path] if names is None else [f"{path}/{n}.shp" for n in names]


class _Reader(DataSourceReader):
    def __init__(self, path: str, fields: list[str]):
        self.path, self.fields = path, fields

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            index = _beside(path, ".shx")
            n = None if index is None else ((size(index) or 100) - 100) // 8
            out += [InputPartition((path, 0, None))] if n is None else [InputPartition((path, i, min(n, i + RECORDS_PER_TASK))) for i in range(0, n, RECORDS_PER_TASK)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, first, last = partition.value
        encoding = _encoding(path)
        index, table = _beside(path, ".shx"), _beside(path, ".dbf")
        with opened(path) as shp, opened(table) as dbf:
            fields, count, header, width = dbf_fields(dbf)
            at = 100
            if index and first:
                with opened(index) as f:
                    f.seek(100 + 8 * first)
                    at = 2 * struct.unpack(">i", f.read(4))[0]
            shp.seek(at)
            dbf.seek(header + width * first)
            n = first
            while n < count and (last is None or n < last):
                head, row = shp.read(8), dbf.read(width)
                if len(head) < 8 or len(row) < width:
                    return
                content = shp.read(2 * struct.unpack(">2i", head)[1])
                n += 1
                if row[:1] == b"*":
                    continue
                values, p = [], 1
                for _, _, length in fields:
                    values.append(_text(row[p : p + length], encoding).strip("\0 ") or None)
                    p += length
                lon, lat, rings = geometry(content)
                largest = max(rings, key=lambda r: abs(area(r))) if rings else None
                yield (*values, lon, lat, largest, rings)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _names(self) -> list[str]:
        path = next(iter(_files(self.options["path"])), None)
        if path is None:
            return []
        with opened(_beside(path, ".dbf")) as f:
            return [_text(n, _encoding(path)) for n, _, _ in dbf_fields(f)[0]]

    def schema(self) -> str:
        ring = "array<struct<x:double,y:double>>"
        return ", ".join([*(f"`{n}` string" for n in self._names()), "lon double", "lat double", f"ring {ring}", f"rings array<{ring}>"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["path"], overwrite, "layer", ("shp", "shx", "dbf", "cpg"), _encoder(schema.fieldNames()), RECORDS_PER_TASK)


def _encoder(columns: list[str]):
    names = [c for c in columns if c not in ("lon", "lat", "ring", "rings")]

    def shape(row):
        get = lambda c: row[c] if c in columns else None
        rings = get("rings") or (get("ring") and [get("ring")])
        if rings:
            return [[(float(p["x"]), float(p["y"])) for p in r] for r in rings if r]
        return None if get("lon") is None or get("lat") is None else (float(get("lon")), float(get("lat")))

    return lambda rows: encoders.shapefile(names, [["" if r[n] is None else str(r[n]) for n in names] for r in rows], [shape(r) for r in rows])


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(ShapefileSource)
