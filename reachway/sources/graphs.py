"""Road graphs of a role and profile: from the cache, a map extract, the Overpass service, or a synthetic stand-in, in this order.

The cache is Parquet: nodes and edges as one set (versions.py) under graph=<role>-<profile>-<fingerprint>, with the provider's name in a column. The fingerprint covers what the graph depends on.
"""

from __future__ import annotations

import hashlib
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachway import config
from reachway.operators.graph import profile_edges
from reachway.sources import osm, overpass, synthetic, versions
from reachway.sources.parts import listed
from reachway.sources.paths import size

log = logging.getLogger(__name__)


def from_extract(spark: SparkSession, path: str, role: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a role's box in an .osm.pbf file; all components are kept."""
    osm.register(spark)
    nodes, ways = (spark.read.format(f).load(path) for f in ("osm_nodes", "osm_ways"))
    nodes, ways = osm.in_extract(nodes, ways, config.DEPARTMENTS[role])
    edges = profile_edges(osm.road_edges(nodes, ways), profile)
    if edges.isEmpty():
        raise ValueError(f"no roads for {profile} in {role}")
    used = ways.filter(F.col("tags")["highway"].isNotNull()).select(F.explode("refs").alias("node_id")).distinct()
    return nodes.join(used, "node_id", "left_semi"), edges


def from_overpass(spark: SparkSession, role: str, profile: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """nodes and edges from the service, tile by tile in tasks (cycling uses the driving network). options: those of overpass.elements."""
    nodes, ways = overpass.elements(spark, config.DEPARTMENTS[role], **options)
    return nodes, profile_edges(osm.road_edges(nodes, ways), "drive" if profile == "bike" else profile)


def get_graph(spark: SparkSession, role: str, profile: str, cache: str, extract: str | None = None, online: bool = False, force: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame, str]:
    """nodes, edges and the name of the provider that gave them: osm-pbf, osm-overpass or synthetic. A provider that fails is logged, and the next one is asked."""
    mark = hashlib.sha256(json.dumps([role, profile, extract and [extract, listed(extract) or size(extract)], online, seed, config.DEPARTMENTS[role]]).encode()).hexdigest()[:12]
    folder = f"{cache}/graph={role}-{profile}-{mark}"
    found = None if force else versions.read_set(spark, folder)
    if found is None:
        providers = [("osm-pbf", lambda: from_extract(spark, extract, role, profile))] if extract else []
        providers += [("osm-overpass", lambda: from_overpass(spark, role, profile))] if online else []
        providers.append(("synthetic", lambda: synthetic.road_graph(spark, role, profile, seed=seed)))
        for name, make in providers:
            try:
                nodes, edges = make()
                versions.write_set({k: df.withColumn("source", F.lit(name)) for k, df in (("nodes", nodes), ("edges", edges))}, folder)
                break
            except Exception as e:
                if name == "synthetic":
                    raise
                log.warning("%s gave no graph of %s for %s: %s", name, role, profile, e)
        found = versions.read_set(spark, folder)
    nodes, edges = (found[t] for t in ("nodes", "edges"))
    return nodes.drop("source"), edges.drop("source"), nodes.select("source").first()[0]
