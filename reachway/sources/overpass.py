"""Roads from an Overpass service as a Spark data source: `spark.read.format("overpass")`, one task for each tile of a box.

Each task asks for the roads that have a node in its tile, with all nodes of these, and asks again after a while where the service is busy, slow or broken. Roads and nodes that several tiles
see come more than once; `elements` takes them once. Instead of the service, answers that were recorded by tile can be read (option `recorded`: a folder with a folder `tile=<number>` each).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from reachway.functions.workers import ready
from reachway.sources.paths import located

SERVICE = "https://overpass-api.de/api/interpreter"
#: Tiles on each side of a box, attempts at a tile, and seconds before the second attempt (twice as many before each further one).
TILES, ATTEMPTS, PAUSE = 4, 5, 10.0


def tiles(box: Mapping[str, float], n: int) -> list[tuple[float, float, float, float]]:
    """south, west, north, east of n by n tiles that cover a box; neighbours share their border."""
    cut = lambda low, high: [low + (high - low) * i / n for i in range(n)] + [high]
    ys, xs = cut(box["south"], box["north"]), cut(box["west"], box["east"])
    return [(ys[i], xs[j], ys[i + 1], xs[j + 1]) for i in range(n) for j in range(n)]


def asked(url: str, tile: tuple[float, float, float, float], timeout: float, attempts: int, pause: float) -> list[dict]:
    """The elements of a tile. An answer that stopped half-way (it has a remark then) is none."""
    south, west, north, east = tile
    query = f"[out:json][timeout:{int(timeout)}];way[highway]({south},{west},{north},{east});(._;>;);out;"
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(url, urllib.parse.urlencode({"data": query}).encode(), timeout=timeout) as answer:
                found = json.load(answer)
            if "remark" not in found:
                return found["elements"]
            problem: Exception = RuntimeError(found["remark"])
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504):
                raise
            problem = e
        except (OSError, ValueError) as e:  # connections, timeouts, cut answers
            problem = e
    raise RuntimeError(f"{attempts} attempts at tile {tile} failed; the last one: {problem}")


def recorded(folder: str, number: int) -> list[dict]:
    from pyarrow import fs

    system, own = located(f"{folder}/tile={number}")
    names = [f.path for f in system.get_file_info(fs.FileSelector(own, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    out = []
    for name in names:
        with system.open_input_file(name) as f:
            out += [e for line in f.read().decode().splitlines() if line for e in json.loads(line)["elements"]]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        box = {k: float(self.options[k]) for k in ("south", "west", "north", "east")}
        return [InputPartition(t) for t in enumerate(tiles(box, int(self.options.get("tiles", TILES))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, tile = partition.value
        o = self.options
        if "recorded" in o:
            found = recorded(o["recorded"], number)
        else:
            found = asked(o.get("url", SERVICE), tile, float(o.get("timeout", 240)), int(o.get("attempts", ATTEMPTS)), float(o.get("pause", PAUSE)))
        for e in found:
            if e["type"] == "node":
                yield "node", int(e["id"]), float(e["lon"]), float(e["lat"]), None, None
            elif e["type"] == "way":
                yield "way", int(e["id"]), None, None, [int(x) for x in e["nodes"]], e.get("tags") or {}


class Overpass(DataSource):
    @classmethod
    def name(cls) -> str:
        return "overpass"

    def schema(self) -> str:
        return "type string, id long, x double, y double, refs array<long>, tags map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(Overpass)


def elements(spark: SparkSession, box: Mapping[str, float], **options: object) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, x, y) and ways (way_id, refs, tags) of a box, each once. The answers are checkpointed: the service is asked once, and a lost executor doesn't ask again.

    options: tiles, url, timeout, attempts, pause, recorded.
    """
    register(spark)
    reader = spark.read.format("overpass")
    for k, v in {**{k: box[k] for k in ("south", "west", "north", "east")}, **options}.items():
        reader = reader.option(k, str(v))
    found = reader.load().checkpoint()
    nodes = found.filter("type = 'node'").groupBy(F.col("id").alias("node_id")).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    ways = found.filter("type = 'way'").groupBy(F.col("id").alias("way_id")).agg(F.first("refs").alias("refs"), F.first("tags").alias("tags"))
    return nodes, ways

