"""The bytes of files that the sinks write: shapefiles and map extracts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping, Sequence

from reachway.functions.geo import area, polygon_parts

Ring = Sequence[tuple[float, float]]


def _dbf(names: Sequence[str], records: Sequence[Sequence[str]]) -> bytes:
    """Character fields, each as wide as its longest value in UTF-8."""
    rows = [[v.encode() for v in r] for r in records]
    widths = [max([1, *map(len, column)]) for column in zip(*rows, strict=True)] if rows else [1] * len(names)
    if max(widths, default=0) > 254 or any(len(n.encode()) > 10 for n in names):
        raise ValueError("a field of a shapefile has up to 254 bytes, its name up to 10")
    out = [struct.pack("<4BIHH20x", 3, 125, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(widths))]
    out += [struct.pack("<11sc4xB15x", name.encode(), b"C", size) for name, size in zip(names, widths, strict=True)]
    out.append(b"\r")
    out += [b" " + b"".join(v.ljust(size) for v, size in zip(r, widths, strict=True)) for r in rows]
    return b"".join(out)


def _content(shape: tuple[float, float] | Sequence[Ring] | None) -> bytes:
    """A point, a polygon (outer rings run clockwise and holes the other way, as the format wants them; rings are closed), or nothing."""
    if not shape:
        return struct.pack("<i", 0)
    if isinstance(shape[0], float):
        return struct.pack("<i2d", 1, *shape)
    rings = []
    for outer, *holes in polygon_parts([[*r[:-1]] if len(r) > 1 and r[0] == r[-1] else [*r] for r in shape]):
        rings.append(outer if area(outer) < 0 else outer[::-1])
        rings += [h if area(h) > 0 else h[::-1] for h in holes]
    rings = [[*r, r[0]] for r in rings]
    xs, ys = zip(*(p for r in rings for p in r), strict=True)
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    return struct.pack(f"<i4d2i{len(rings)}i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(xs), *starts) + b"".join(struct.pack("<2d", *p) for r in rings for p in r)


def shapefile(names: Sequence[str], records: Sequence[Sequence[str]], shapes: Sequence) -> dict[str, bytes]:
    """The files of a shapefile by ending. shapes: a point (x, y), rings, or None for each record."""
    contents = [_content(s) for s in shapes]
    kinds = {struct.unpack("<i", c[:4])[0] for c in contents} - {0}
    if len(kinds) > 1:
        raise ValueError("points and polygons don't go into one shapefile")
    main, index, place = [], [], 50
    for number, c in enumerate(contents, 1):
        words = len(c) // 2
        main.append(struct.pack(">2i", number, words) + c)
        index.append(struct.pack(">2i", place, words))
        place += 4 + words
    head = lambda parts: struct.pack(">i20xi", 9994, 50 + sum(map(len, parts)) // 2) + struct.pack("<2i64x", 1000, max(kinds, default=1))
    return {"shp": head(main) + b"".join(main), "shx": head(index) + b"".join(index), "dbf": _dbf(names, records), "cpg": b"UTF-8"}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _entry(field: int, value: int | bytes) -> bytes:
    return _number(field << 3) + _number(value) if isinstance(value, int) else _number(field << 3 | 2) + _number(len(value)) + value


def _steps(values: Sequence[int]) -> bytes:
    """Differences in zigzag form."""
    return b"".join(_number(2 * d if d >= 0 else -2 * d - 1) for d in (b - a for a, b in zip([0, *values], values, strict=False)))


def map_extract(nodes: Sequence[tuple[int, float, float]], ways: Sequence[tuple[int, Sequence[int], Mapping[str, str]]], per_blob: int = 1_000) -> bytes:
    """An .osm.pbf file. nodes: id, lon, lat; ways: id, refs, tags."""
    strings = [""] + sorted({x for _, _, tags in ways for kv in tags.items() for x in kv})
    at = {s: i for i, s in enumerate(strings)}
    table = _entry(1, b"".join(_entry(1, s.encode()) for s in strings))
    groups = []
    for i in range(0, len(nodes), per_blob):
        ids, lons, lats = zip(*nodes[i : i + per_blob], strict=True)
        units = lambda v: _steps([round(x * 1e7) for x in v])
        groups.append(_entry(2, _entry(1, _steps(ids)) + _entry(8, units(lats)) + _entry(9, units(lons))))
    for i in range(0, len(ways), per_blob):
        group = b""
        for way_id, refs, tags in ways[i : i + per_blob]:
            keys, values = (b"".join(_number(at[x]) for x in kv) for kv in (tags.keys(), tags.values()))
            group += _entry(3, _entry(1, way_id) + _entry(2, keys) + _entry(3, values) + _entry(8, _steps(refs)))
        groups.append(group)
    out = []
    for kind, body in [(b"OSMHeader", _entry(1, b"")), *((b"OSMData", table + _entry(2, g)) for g in groups)]:
        blob = _entry(2, len(body)) + _entry(3, zlib.compress(body))
        head = _entry(1, kind) + _entry(3, len(blob))
        out.append(struct.pack(">I", len(head)) + head + blob)
    return b"".join(out)
