"""The dashboard's questions: filters, key figures, and what an upgrade of facilities would change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway import config
from reachway.operators.access import weighted_mean_access
from reachway.operators.modes import nearest_facility
from reachway.operators.ranks import group_medians


def chosen(df: DataFrame, **filters: Sequence | None) -> DataFrame:
    """The rows whose columns have one of the chosen values; None leaves a column free, an empty choice leaves nothing."""
    for column, values in filters.items():
        if values is not None:
            df = df.filter(F.col(column).isin(*values) if len(values) else F.lit(False))
    return df


def choices(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, in order, nulls left out."""
    return df.select(column).dropna().distinct().orderBy(column)


def key_figures(demand: DataFrame, threshold: float = 60) -> DataFrame:
    """One row: poblacion_total, poblacion_cubierta, poblacion_mas_60 (no time counts as more), poblacion_estimada (estimates and rows without a time), mediana_acceso, and the three shares."""
    p, t = F.col("poblacion"), F.col("t_min")
    of = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0))
    est = F.coalesce(F.col("t_min_estimado"), F.lit(False)) if "t_min_estimado" in demand.columns else F.lit(False)
    out = demand.agg(
        F.coalesce(F.sum(p), F.lit(0)).alias("poblacion_total"), of(t <= threshold).alias("poblacion_cubierta"), of((t > 60) | t.isNull()).alias("poblacion_mas_60"),
        (of(est) + of(t.isNull())).alias("poblacion_estimada"),
    ).crossJoin(group_medians(demand, "t_min", name="mediana_acceso"))
    share = lambda c: F.try_divide(F.col(c) * F.lit(100.0), F.col("poblacion_total"))
    return out.withColumns({"pct_cubierta": share("poblacion_cubierta"), "pct_mas_60": share("poblacion_mas_60"), "pct_estimada": share("poblacion_estimada")})


def worst_district(demand: DataFrame) -> DataFrame:
    """distrito, t_min_ponderado of the slowest district; no row without one."""
    return weighted_mean_access(demand, "distrito", estimated=None).filter("t_min_ponderado IS NOT NULL").select("distrito", "t_min_ponderado").limit(1)


def critical_table(demand: DataFrame) -> DataFrame:
    """Every district with its mean time, population and share of estimates (of rows without a time where no column marks estimates); slowest first."""
    p, t = F.col("poblacion"), F.col("t_min")
    est = F.coalesce(F.col("t_min_estimado"), F.lit(False)) if "t_min_estimado" in demand.columns else t.isNull()
    w = F.sum(F.when(t.isNotNull(), p))
    out = demand.filter("distrito IS NOT NULL").groupBy("distrito").agg(
        F.when(w > 0, F.sum(t * p) / w).alias("t_min_ponderado"), F.sum(p).alias("poblacion"), F.when(F.sum(p) > 0, F.lit(100.0) * F.coalesce(F.sum(F.when(est, p)), F.lit(0)) / F.sum(p)).alias("pct_estimado_por_desvio")
    )
    return out.orderBy(F.desc_nulls_last("t_min_ponderado"), "distrito")


def choropleth(districts: DataFrame, demand: DataFrame, key: str = "ubigeo") -> DataFrame:
    """Districts with the access and population of their demand points; nulls where they have none. One aggregate serves both joins."""
    p = demand.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("poblacion").alias("poblacion"))
    return districts.join(weighted_mean_access(demand, key), key, "left").join(p, key, "left")


def upgrade(matrix: DataFrame, demand: DataFrame, upgraded: DataFrame) -> DataFrame:
    """cp_id, facility_id, t_min_antes, t_min_despues of the points for which one of the upgraded facilities (facility_id) is strictly faster than
    now. Facilities outside the matrix change nothing."""
    offers = matrix.join(upgraded.select("facility_id").distinct(), "facility_id", "left_semi")
    now = demand.select("cp_id", F.col("t_min").alias("t_min_antes"))
    better = offers.join(now, "cp_id").filter(F.col("t_min") < F.col("t_min_antes")).select("cp_id", "facility_id", "t_min")
    best = nearest_facility(better)
    return best.join(now, "cp_id").select("cp_id", "facility_id", "t_min_antes", F.col("t_min").alias("t_min_despues"))


def upgrade_gain(changed: DataFrame, demand: DataFrame) -> DataFrame:
    """One row: points and population that an upgrade helps."""
    return changed.join(demand.select("cp_id", "poblacion"), "cp_id").agg(F.count("*").alias("puntos"), F.coalesce(F.sum("poblacion"), F.lit(0)).alias("poblacion_ganada"))


def upgradable(facilities: DataFrame) -> DataFrame:
    """Facilities of the categories that the simulator offers, active or not."""
    return facilities.filter(F.col("categoria").isin(*config.UPGRADABLE_CATEGORIES))


def bounds(points: DataFrame) -> DataFrame:
    """One row: the box of points with coordinates and its centre."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumns({f"centro_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("lon", "lat")})


def overlay(layer: DataFrame, facilities: DataFrame) -> DataFrame:
    """The rows of a layer (isochrones, a matrix) that belong to the chosen facilities."""
    return layer.join(facilities.select("facility_id").distinct(), "facility_id", "left_semi")


def columns_with(df: DataFrame, prefix: str) -> list[str]:
    """The columns whose names start so."""
    return [c for c in df.columns if c.startswith(prefix)]
