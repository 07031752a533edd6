"""OpenStreetMap extracts (.osm.pbf) as Spark data sources: `osm_nodes` and `osm_ways`, and road edges made of them.

A file is a chain of blobs that can be read on their own: the driver lists their places, tasks decode them. A folder of parts (parts.py), which tasks write, is read as one extract: nodes and ways are
written to the same folder, one after the other, by `df.write.format(...).mode("append")`. The decoder reads the parts of the
protocol-buffer format that roads need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from reachway.functions.workers import ready
from reachway.sources import encoders
from reachway.sources.parts import PartWriter, listed
from reachway.sources.paths import opened, size

BLOBS_PER_TASK = 16
#: Nodes or ways of a part that a task writes.
RECORDS_PER_FILE = 100_000


def varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: numbers for varints, bytes for the rest."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            length, at = varint(data, at) if kind == 2 else ((8 if kind == 1 else 4), at)
            value, at = data[at : at + length], at + length
        yield key >> 3, value


def packed(data: bytes, signed: bool = True) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def summed(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blobs(path: str) -> list[tuple[int, int]]:
    """Place and size of every data blob."""
    out, at, end = [], 0, size(path) or 0
    with opened(path) as f:
        while at < end:
            f.seek(at)
            n = struct.unpack(">I", f.read(4))[0]
            head = dict(fields(f.read(n)))
            if head[1] == b"OSMData":
                out.append((at + 4 + n, head[3]))
            at += 4 + n + head[3]
    return out


def _block(path: str, at: int, length: int) -> tuple[list[bytes], list[bytes], int, int, int]:
    with opened(path) as f:
        f.seek(at)
        blob = dict(fields(f.read(length)))
    data = blob[1] if 1 in blob else zlib.decompress(blob[3])
    strings, groups, scale, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            strings = [x for _, x in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    return strings, groups, scale, lat0, lon0


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = listed(self.path)
        files = [self.path] if names is None else [f"{self.path}/{n}.osm.pbf" for n in names]
        every = [(f, *b) for f in files for b in blobs(f)]
        return [InputPartition(every[i : i + BLOBS_PER_TASK]) for i in range(0, len(every), BLOBS_PER_TASK)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, at, length in partition.value:
            yield from self.rows(*_block(path, at, length))

    def rows(self, strings, groups, scale, lat0, lon0) -> Iterator[tuple]:
        raise NotImplementedError


class _Nodes(_Reader):
    def rows(self, strings, groups, scale, lat0, lon0):
        for g in groups:
            for k, v in fields(g):
                if k == 2:
                    dense = dict(fields(v))
                    columns = [summed(packed(dense.get(i, b""))) for i in (1, 8, 9)]
                    for i, lat, lon in zip(*columns, strict=True):
                        yield i, (lon0 + scale * lon) * 1e-9, (lat0 + scale * lat) * 1e-9
                elif k == 1:
                    node = dict(fields(v))
                    i, lat, lon = ((x >> 1) ^ -(x & 1) for x in (node[1], node[8], node[9]))
                    yield i, (lon0 + scale * lon) * 1e-9, (lat0 + scale * lat) * 1e-9


class _Ways(_Reader):
    def rows(self, strings, groups, scale, lat0, lon0):
        for g in groups:
            for k, v in fields(g):
                if k == 3:
                    way = dict(fields(v))
                    keys, values = (packed(way.get(i, b""), signed=False) for i in (2, 3))
                    tags = {strings[a].decode("utf-8", "replace"): strings[b].decode("utf-8", "replace") for a, b in zip(keys, values, strict=True)}
                    yield way[1], summed(packed(way.get(8, b""))), tags


class OsmNodes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_nodes"

    def schema(self) -> str:
        return "node_id long, x double, y double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Nodes(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["path"], overwrite, "nodes", ("osm.pbf",), _node_file, RECORDS_PER_FILE)


class OsmWays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_ways"

    def schema(self) -> str:
        return "way_id long, refs array<long>, tags map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Ways(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["path"], overwrite, "ways", ("osm.pbf",), _way_file, RECORDS_PER_FILE)


def _node_file(rows: list) -> dict[str, bytes]:
    return {"osm.pbf": encoders.map_extract([(r["node_id"], r["x"], r["y"]) for r in rows], [])}


def _way_file(rows: list) -> dict[str, bytes]:
    return {"osm.pbf": encoders.map_extract([], [(r["way_id"], r["refs"], r["tags"] or {}) for r in rows])}


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(OsmNodes)
    spark.dataSource.register(OsmWays)


def in_extract(nodes: DataFrame, ways: DataFrame, box: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of a box (north, south, east, west; closed): ways with a node inside, and all nodes that these refer to."""
    inside = nodes.filter(F.col("x").between(box["west"], box["east"]) & F.col("y").between(box["south"], box["north"])).select("node_id")
    refs = ways.select("way_id", F.explode("refs").alias("node_id"))
    kept = refs.join(inside, "node_id", "left_semi").select("way_id").distinct()
    ways = ways.join(kept, "way_id", "left_semi")
    needed = ways.select(F.explode("refs").alias("node_id")).unionByName(inside).distinct()
    return nodes.join(needed, "node_id", "left_semi"), ways


def road_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """src, dst, length (m, great circle), highway, maxspeed of both directions of every road segment, one direction on one-way roads."""
    roads = ways.filter(F.col("tags")["highway"].isNotNull())
    pair = F.arrays_zip(F.slice("refs", F.lit(1), F.size("refs") - 1).alias("a"), F.slice("refs", F.lit(2), F.size("refs") - 1).alias("b"))
    steps = roads.filter(F.size("refs") > 1).select(F.explode(pair).alias("p"), F.col("tags")["highway"].alias("highway"), F.col("tags")["maxspeed"].alias("maxspeed"), F.col("tags")["oneway"].alias("oneway"))
    steps = steps.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), "highway", "maxspeed", "oneway")
    a, b = (nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in ("src", "dst"))
    met = steps.join(a, "src").join(b, "dst")
    ya, yb = F.radians("ysrc"), F.radians("ydst")
    h = F.pow(F.sin((yb - ya) / 2), 2) + F.cos(ya) * F.cos(yb) * F.pow(F.sin(F.radians(F.col("xdst") - F.col("xsrc")) / 2), 2)
    met = met.withColumn("length", 2 * 6371009.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))
    forward = met.filter(~F.coalesce(F.col("oneway") == "-1", F.lit(False))).select("src", "dst", "length", "highway", "maxspeed")
    back = met.filter(~F.coalesce(F.col("oneway").isin("yes", "true", "1"), F.lit(False))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length", "highway", "maxspeed")
    return forward.unionByName(back)
