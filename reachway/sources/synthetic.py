"""Synthetic departments: points, facilities, dirty records and road graphs, by counter-based random numbers.

A number is the SHA-256 of seed, name and row id, so that each row's numbers follow from its id alone: the same on any cluster, in any order, and in any engine that has that hash. Rows come
from a given table with ids, or from a range of them; the sequence is this engine's own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachway import config
from reachway.operators.access import thirds
from reachway.operators.modes import nearest_points, projected


def unit(seed: int, salt: str) -> Column:
    """A number in [0, 1), a multiple of 2**-32, from the row's id."""
    said = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("id").cast("string")), 256)
    return F.conv(F.substring(said, 1, 8), 16, 10).cast("double") / float(1 << 32)


def unit_sql(seed: int, salt: str, key: str = "id") -> str:
    """The same number in SQL."""
    return f"(CAST('0x' || substr(sha256('{seed}:{salt}:' || {key}), 1, 8) AS BIGINT) / 4294967296e0)"


def _pick(values: list, seed: int, salt: str, weights: list[float] | None = None) -> Column:
    u, total, out = unit(seed, salt), 0.0, None
    for v, w in zip(values, weights or [1 / len(values)] * len(values), strict=True):
        total += w
        out = (F.when(u < total, F.lit(v)) if out is None else out.when(u < total, F.lit(v)))
    return out.otherwise(F.lit(values[-1]))


def _placed(df: DataFrame, box: Mapping, seed: int) -> DataFrame:
    lon = box["west"] + unit(seed, "lon") * (box["east"] - box["west"])
    lat = box["south"] + unit(seed, "lat") * (box["north"] - box["south"])
    return df.withColumn("lon", lon).withColumn("lat", lat)


def soiled(df: DataFrame, kind: Column | None = None) -> DataFrame:
    """df (with id, lon, lat) with about a twelfth of its rows made dirty, in equal parts: (0, 0), swapped, the place of the row before, far outside. kind: 0 to 3 picks one of these for a
    row, anything else none; by default it is drawn from the id."""
    k = F.floor(unit(0, "dirt") * 48) if kind is None else kind
    before = df.select((F.col("id") + 1).alias("id"), F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
    both = df.join(before, "id", "left")
    lon = F.when(k == 0, 0.0).when(k == 1, F.col("lat")).when(k == 2, F.coalesce("__lon", "lon")).when(k == 3, 10.0).otherwise(F.col("lon"))
    lat = F.when(k == 0, 0.0).when(k == 1, F.col("lon")).when(k == 2, F.coalesce("__lat", "lat")).when(k == 3, 10.0).otherwise(F.col("lat"))
    return both.withColumns({"lon": lon, "lat": lat}).drop("__lon", "__lat")


def demand(spark: SparkSession, role: str, n: int = 200, seed: int = 42) -> DataFrame:
    return demand_for(spark.range(n), role, seed)


def demand_for(base: DataFrame, role: str, seed: int = 42) -> DataFrame:
    """Demand points of a department, one for each row of base (id: long, unique): what is drawn depends on the id and the seed alone."""
    box = config.DEPARTMENTS[role]
    short = box["nombre"][:3].upper()
    rows = _placed(base.select("id"), box, seed)
    rows = thirds(thirds(rows, "lat", ["1", "2", "3"], "fila"), "lon", ["A", "B", "C"], "columna")
    rows = rows.select(
        "id", F.concat(F.lit(f"{role[:3].upper()}-CP-"), F.format_string("%04d", "id")).alias("cp_id"), F.concat(F.lit("Centro Poblado "), "id").alias("nombre"), (20 + F.floor(unit(seed, "pop") * 4980)).cast("long").alias("poblacion"), F.lit(box["nombre"]).alias("departamento"),
        F.round(50 + unit(seed, "alt") * 4450).alias("altitud_m"), F.concat(F.lit(f"{short}-"), "fila", "columna").alias("distrito"), F.concat(F.lit(f"{short}-PROV-"), "fila").alias("provincia"), "lon", "lat", F.lit(role).alias("rol"),
    )
    return soiled(rows).drop("id")


def facilities(spark: SparkSession, role: str, n: int = 20, seed: int = 42) -> DataFrame:
    return facilities_for(spark.range(n), role, seed)


def facilities_for(base: DataFrame, role: str, seed: int = 42) -> DataFrame:
    """Facilities of a department, one for each row of base (id: long, unique)."""
    box = config.DEPARTMENTS[role]
    rows = _placed(base.select("id"), box, seed + 1)
    rows = rows.select(
        "id", F.concat(F.lit(f"{role[:3].upper()}-EESS-"), F.format_string("%04d", "id")).alias("facility_id"), F.concat(F.lit("Establecimiento "), "id").alias("nombre"), _pick(["I-1", "I-2", "I-3", "I-4", *sorted(config.SURGICAL_CATEGORIES)], seed, "cat").alias("categoria"),
        _pick(["MINSA", "ESSALUD", "PRIVADO"], seed, "ins", [0.7, 0.2, 0.1]).alias("institucion"), _pick([True, True, True, False], seed, "act").alias("activo"), (1 + F.floor(unit(seed, "cap") * 19)).cast("long").alias("capacidad"), F.lit(box["nombre"]).alias("departamento"), "lon", "lat", F.lit(role).alias("rol"),
    )
    return soiled(rows).drop("id")


def knn_graph(nodes: DataFrame, k: int = 5) -> DataFrame:
    """src, dst, length of both directions between each node (id, x, y in metres) and its k nearest others; parallel edges may arise."""
    near = nearest_points(nodes, nodes, k, skip_self=True)
    out = near.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.col("dist").alias("length"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length"))


def road_graph(spark: SparkSession, role: str, profile: str, n: int = 250, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, x, y in degrees) and edges (src, dst, length, travel_time) of random nodes in a department's box, joined to their nearest neighbours."""
    nodes = _placed(spark.range(n), config.DEPARTMENTS[role], seed + 2)
    speed = config.PROFILE_SPEED_KMH[profile] * 1000 / 3600
    edges = knn_graph(projected(nodes), k).withColumn("travel_time", F.col("length") / speed)
    return nodes.select(F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y")), edges
