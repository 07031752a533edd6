"""Nearest facilities by network and in a straight line, comparisons of profiles, and fallback times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachway import config
from reachway.functions.geo import GridIndex, utm, utm_epsg
from reachway.functions.workers import ready
from reachway.operators.leaves import nearest_by_leaves
from reachway.operators.ranks import group_medians

#: Target points up to this number (24 bytes each) are broadcast as a grid index; more of them are met by leaves in shuffles.
BROADCAST_POINTS = 2_000_000


def nearest_facility(matrix: DataFrame, *keys: str) -> DataFrame:
    """cp_id (and further keys), facility_id, t_min of the least time of each point; the least id where times tie. Points without any route are absent."""
    best = matrix.filter("t_min IS NOT NULL").groupBy(*keys, "cp_id").agg(F.min(F.struct("t_min", "facility_id")).alias("m"))
    return best.select(*keys, "cp_id", F.col("m.facility_id").alias("facility_id"), F.col("m.t_min").alias("t_min"))


def compare_modes(matrix: DataFrame, profiles: Sequence[str] = config.PROFILES) -> DataFrame:
    """One row for each point with a drive route: facility and time by profile, whether the facility changes (true without a route), and the
    ratio to drive (null where that takes no time). matrix has a column profile. One aggregation serves all profiles."""
    if "drive" not in profiles:
        raise ValueError("the profile 'drive' is the reference of the comparison")
    best = [F.min(F.when(F.col("profile") == p, F.struct("t_min", "facility_id"))).alias(p) for p in profiles]
    wide = matrix.filter(F.col("t_min").isNotNull() & F.col("profile").isin(*profiles)).groupBy("cp_id").agg(*best).filter("drive IS NOT NULL")
    out = [F.col("cp_id"), F.col("drive.facility_id").alias("facility_drive"), F.col("drive.t_min").alias("t_min_drive")]
    for p in profiles:
        if p != "drive":
            out += [
                F.col(f"{p}.facility_id").alias(f"facility_{p}"), F.col(f"{p}.t_min").alias(f"t_min_{p}"), (~F.col(f"{p}.facility_id").eqNullSafe(F.col("drive.facility_id"))).alias(f"facility_cambia_{p}"),
                F.try_divide(f"{p}.t_min", "drive.t_min").alias(f"ratio_{p}_drive"),
            ]
    return wide.select(*out)


def _search(shared, k: int, skip_self: bool):
    schema = pa.schema([("id", pa.int64()), ("rank", pa.int32()), ("target", pa.int64()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, y = shared.value
        index = GridIndex(ids, x, y)
        for b in batches:
            own, px, py = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(0, len(own), 50_000):
                o = own[i : i + 50_000]
                target, d = index.nearest(px[i : i + 50_000], py[i : i + 50_000], k, o if skip_self else None)
                has = target >= 0
                rank = np.broadcast_to(np.arange(1, k + 1), target.shape)[has]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(o, has.sum(1))), pa.array(rank.astype(np.int32)), pa.array(target[has]), pa.array(np.sqrt(d[has]))], schema=schema)

    return run


def nearest_points(points: DataFrame, targets: DataFrame, k: int = 1, skip_self: bool = False, broadcast_points: int = BROADCAST_POINTS) -> DataFrame:
    """id, rank (1 .. k), target, dist: the k nearest targets of each point, exactly, with ties to the least id. Both have id (long), x and y (double); rows
    with nulls are left out.

    Up to broadcast_points targets go to all workers as a grid index, and points never move. More of them are packed into the leaves of a quadtree (leaves.py), and points meet the leaves that
    they can have neighbours in.
    """
    spark = ready(points.sparkSession)
    points = points.select(F.col("id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).dropna()
    targets = targets.select(F.col("id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).dropna()
    n = targets.count()
    if n <= broadcast_points:
        t = targets.toPandas()
        shared = spark.sparkContext.broadcast((t["id"].to_numpy(np.int64), t["x"].to_numpy(float), t["y"].to_numpy(float)))
        return points.mapInArrow(_search(shared, k, skip_self), "id long, rank int, target long, dist double")
    return nearest_by_leaves(points, targets, n, k, skip_self)


def projected(df: DataFrame, zone: DataFrame | None = None) -> DataFrame:
    """df with x and y in metres, in the UTM zone of the mean coordinate of df (or of zone's rows); rows without coordinates keep nulls."""
    mean = (df if zone is None else zone).agg(F.avg("lon").alias("mlon"), F.avg("lat").alias("mlat"))
    mean = mean.select((F.floor((F.col("mlon") + 180) / 6) + 1).alias("__zone"), (F.col("mlat") < 0).alias("__south"))
    x, y = utm(F.col("lon"), F.col("lat"), F.col("__zone"), F.col("__south"))
    return df.crossJoin(F.broadcast(mean)).withColumn("x", x).withColumn("y", y).drop("__zone", "__south")


def _planes(demand: DataFrame, facilities: DataFrame, planar: bool) -> tuple[DataFrame, DataFrame]:
    d, f = (df.select(F.col(k).alias("id"), "lon", "lat") for df, k in ((demand, "cp_id"), (facilities, "facility_id")))
    if planar:
        return tuple(t.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")) for t in (d, f))
    both = d.select("lon", "lat").unionByName(f.select("lon", "lat"))
    return projected(d, both), projected(f, both)


def straight_nearest(demand: DataFrame, facilities: DataFrame, planar: bool = False) -> DataFrame:
    """cp_id, facility_recta, dist_recta_m: the facility nearest in a straight line, in the UTM zone of all points' mean (planar: in degrees)."""
    d, f = _planes(demand, facilities, planar)
    return nearest_points(d, f).select(F.col("id").alias("cp_id"), F.col("target").alias("facility_recta"), F.col("dist").alias("dist_recta_m"))


def straight_vs_network(matrix: DataFrame, demand: DataFrame, facilities: DataFrame, planar: bool = False) -> DataFrame:
    """What a straight line picks against what the network does, for points with a route; the penalty is null where the pick can't be reached."""
    best = nearest_facility(matrix).select("cp_id", F.col("facility_id").alias("facility_red"), F.col("t_min").alias("t_min_red"))
    both = straight_nearest(demand, facilities, planar).join(best, "cp_id")
    picks = both.select("cp_id", "facility_recta")
    times = matrix.select("cp_id", F.col("facility_id").alias("facility_recta"), "t_min").join(picks, ["cp_id", "facility_recta"], "left_semi").groupBy("cp_id", "facility_recta").agg(F.min("t_min").alias("t_min_si_recta"))
    out = both.join(times, ["cp_id", "facility_recta"], "left")
    return out.select("cp_id", "facility_recta", "dist_recta_m", "facility_red", "t_min_red", (F.col("facility_recta") == F.col("facility_red")).alias("coincide"), "t_min_si_recta", (F.col("t_min_si_recta") - F.col("t_min_red")).alias("penalidad_min"))


def _same(left: DataFrame, right: DataFrame, *groups: str) -> Column:
    return reduce(lambda x, y: x & y, [left[g].eqNullSafe(right[g]) for g in groups], F.lit(True))


def straight_vs_network_summary(svn: DataFrame, group: str) -> DataFrame:
    """By group: share of points whose facility differs, and the exact median penalty of those (null where none has one)."""
    shares = svn.groupBy(group).agg((F.avg((~F.col("coincide")).cast("double")) * 100).alias("pct_facility_distinta"))
    medians = group_medians(svn.filter(~F.col("coincide")), "penalidad_min", group, name="penalidad_min_mediana")
    return shares.join(medians, _same(shares, medians, group), "left").select(shares[group], "pct_facility_distinta", "penalidad_min_mediana")


def circuity_factor(svn: DataFrame, *groups: str, speed_kmh: float = config.DETOUR_SPEED_KMH) -> DataFrame:
    """factor_desvio by group: the exact median of network time over the straight line's at this speed; the default without a routed point at a distance."""
    ratio = F.try_divide(F.col("t_min_red"), F.col("dist_recta_m") / (speed_kmh * 1000 / 60))
    medians = group_medians(svn.select(*groups, ratio.alias("ratio")), "ratio", *groups, name="m")
    factor = F.coalesce("m", F.lit(config.DEFAULT_DETOUR)).alias("factor_desvio")
    if not groups:
        return medians.select(factor)
    every = svn.select(*groups).distinct()
    return every.join(medians, _same(every, medians, *groups), "left").select(*[every[g] for g in groups], factor)


def fallback_times(demand: DataFrame, facilities: DataFrame, factor: DataFrame, planar: bool = False, speed_kmh: float = config.DETOUR_SPEED_KMH) -> DataFrame:
    """cp_id, facility_id_fallback, dist_recta_m_fallback, t_min_fallback: straight distance at this speed times the factor (one row)."""
    near = straight_nearest(demand, facilities, planar).crossJoin(F.broadcast(factor.select("factor_desvio")))
    return near.select("cp_id", F.col("facility_recta").alias("facility_id_fallback"), F.col("dist_recta_m").alias("dist_recta_m_fallback"), (F.col("dist_recta_m") / (speed_kmh * 1000 / 60) * F.col("factor_desvio")).alias("t_min_fallback"))


def demand_metrics(matrix: DataFrame, demand: DataFrame, facilities: DataFrame, planar: bool = False) -> DataFrame:
    """demand with facility_mas_cercana, t_min and t_min_estimado: measured where there is a route, otherwise estimated from the straight line."""
    best = nearest_facility(matrix).select("cp_id", F.col("facility_id").alias("__f"), F.col("t_min").alias("__t"))
    factor = circuity_factor(straight_vs_network(matrix, demand, facilities, planar))
    back = fallback_times(demand, facilities, factor, planar).select("cp_id", "facility_id_fallback", "t_min_fallback")
    joined = demand.join(best, "cp_id", "left").join(back, "cp_id", "left")
    missing = F.col("__t").isNull()
    return joined.select(*[F.col(c) for c in demand.columns], F.when(missing, F.col("facility_id_fallback")).otherwise(F.col("__f")).alias("facility_mas_cercana"), F.when(missing, F.col("t_min_fallback")).otherwise(F.col("__t")).alias("t_min"), missing.alias("t_min_estimado"))


def snap(points: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, planar: bool = False) -> DataFrame:
    """id, node_id, snap_dist_m of the nearest node of each point. points: id, lon, lat; nodes: node_id, x, y in degrees. edges: with them only nodes that
    have an edge count (recommended: a node without edges leads nowhere)."""
    nodes = nodes.select(F.col("node_id").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    if edges is not None:
        live = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        nodes = nodes.join(live, "id", "left_semi")
    points = points.select("id", "lon", "lat")
    if planar:
        p, t = (df.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")) for df in (points, nodes))
    else:
        p, t = projected(points, nodes), projected(nodes)
    return nearest_points(p, t).select("id", F.col("target").alias("node_id"), F.col("dist").alias("snap_dist_m"))


def snap_report(snapped: DataFrame, *groups: str, limit: float = config.SNAP_MAX_M) -> DataFrame:
    """Counts and distances of a snapping; null statistics without points."""
    return snapped.groupBy(*groups).agg(F.count("*").alias("n_puntos"), F.avg("snap_dist_m").alias("snap_dist_m_promedio"), F.max("snap_dist_m").alias("snap_dist_m_max"), F.count_if(F.col("snap_dist_m") > limit).alias("n_sobre_umbral"), F.lit(limit).alias("umbral_metros"))


def points_in_zones(points: DataFrame) -> DataFrame:
    """points (with lon, lat) with utm_epsg, x and y of each point's own zone."""
    zone = F.floor((F.col("lon") + 180) / 6) + 1
    x, y = utm(F.col("lon"), F.col("lat"), zone, F.col("lat") < 0)
    return points.withColumn("utm_epsg", utm_epsg(F.col("lon"), F.col("lat"))).withColumn("x", x).withColumn("y", y)


