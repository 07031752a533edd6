"""Quality rules for georeferenced points, as status columns of one pass.

Rules apply in a fixed order (missing coordinates, swapped coordinates, outside the country, outside the declared polygon, repeated ids,
mis-decoded text), and a row that an earlier rule drops counts for no later one. Points have nullable lon and lat.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachway import config
from reachway.functions.geo import edges_contain, in_box, ring_edges
from reachway.functions.text import normalised_category, repaired

# Names of the rules and of what they do.
RULES = (
    ("coordenadas_nulas_o_cero", "drop"), ("lat_lon_invertidos", "swap_si_cae_en_bbox"), ("fuera_de_bbox_peru", "drop"),
    ("punto_fuera_de_poligono_distrital", "flag"), ("codigos_duplicados", "dedup_keep_mas_completo_o_reciente"), ("encoding_utf8_vs_latin1", "reencode_donde_aplica"),
)
NO_POLYGONS = "sin capa de polígonos disponible — regla no evaluada"


def missing(lon: Column, lat: Column) -> Column:
    """No coordinates, or exactly (0, 0)."""
    return lon.isNull() | lat.isNull() | ((lon == 0) & (lat == 0))


def with_status(df: DataFrame, box: Mapping[str, float] = config.COUNTRY_BBOX) -> DataFrame:
    """df with corrected lon and lat and q_missing, q_swapped, q_outside (booleans, in the order of the rules)."""
    lon, lat = F.col("lon"), F.col("lat")
    gone = missing(lon, lat)
    inside = F.coalesce(in_box(lon, lat, box), F.lit(False))
    swapped = ~gone & ~inside & F.coalesce(in_box(lat, lon, box), F.lit(False))
    status = df.withColumns({"q_missing": gone, "q_swapped": swapped, "q_outside": ~gone & ~inside & ~swapped})
    return status.withColumns({"lon": F.when(F.col("q_swapped"), lat).otherwise(lon), "lat": F.when(F.col("q_swapped"), lon).otherwise(lat)})


def drop_missing(df: DataFrame) -> DataFrame:
    return df.filter(~missing(F.col("lon"), F.col("lat")))


def unswap(df: DataFrame, box: Mapping[str, float] = config.COUNTRY_BBOX) -> DataFrame:
    return with_status(df, box).drop("q_missing", "q_swapped", "q_outside")


def drop_outside(df: DataFrame, box: Mapping[str, float] = config.COUNTRY_BBOX) -> DataFrame:
    return df.filter(F.coalesce(in_box(F.col("lon"), F.col("lat"), box), F.lit(False)))


#: Edges of a polygon for each of its strips, about, and strips of a polygon at most.
STRIP_EDGES, MAX_STRIPS = 16, 8_192


def polygon_strips(polygons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Polygons as heads (__key, __y0, __height, __strips) and, for each horizontal strip of equal height, the edges that reach into it (__k, __strip, __edges).

    polygons has rings (array of array of struct x, y: all parts and holes), or ring where there is one only. One polygon is kept for each key, the least by its rings; those without any ring are none.
    """
    shape = F.array("ring") if "rings" not in polygons.columns else F.coalesce("rings", F.array("ring")) if "ring" in polygons.columns else F.col("rings")
    rings = F.filter(shape, lambda r: F.coalesce(F.size(r) > 0, F.lit(False)))
    one = polygons.select(F.col(key).alias("__key"), rings.alias("rings")).filter(F.col("__key").isNotNull() & (F.size("rings") > 0)).groupBy("__key").agg(F.min("rings").alias("rings"))
    edges = one.select("__key", ring_edges(F.col("rings")).alias("edges"))
    low = F.array_min(F.transform("edges", lambda e: F.least(e["y1"], e["y2"])))
    high = F.array_max(F.transform("edges", lambda e: F.greatest(e["y1"], e["y2"])))
    n = F.least(F.lit(MAX_STRIPS), F.greatest(F.lit(1), F.ceil(F.size("edges") / F.lit(STRIP_EDGES)))).cast("int")
    heads = edges.select("__key", "edges", low.alias("__y0"), n.alias("__strips"), ((high - low) / n).alias("__height"))
    each = heads.select(F.col("__key").alias("__k"), "__y0", "__height", "__strips", F.explode("edges").alias("e"))
    reach = F.sequence(strip(F.least("e.y1", "e.y2")), strip(F.greatest("e.y1", "e.y2")))
    strips = each.select("__k", "e", F.explode(reach).alias("__strip")).groupBy("__k", "__strip").agg(F.collect_list("e").alias("__edges"))
    return heads.drop("edges"), strips


def strip(y: Column) -> Column:
    """The number of the strip at this height, by a polygon's head; it never falls where y rises, so that an edge reaches all strips between its ends'."""
    at = F.floor(F.coalesce(F.try_divide(y - F.col("__y0"), F.col("__height")), F.lit(0.0)))
    return F.greatest(F.lit(0), F.least(F.col("__strips") - 1, at)).cast("int")


def flag_outside_polygon(df: DataFrame, polygons: DataFrame | None, key: str, polygon_key: str = "ubigeo") -> DataFrame:
    """df with flag_fuera_de_poligono: its key's polygon (all of its rings: parts, islands and holes) exists and doesn't hold the point in its interior.

    A point meets the edges of one strip of its polygon only. Polygons are one for each key, and strips one for each key and number, so that the joins never add rows; points of a hot key are dealt by strips.
    """
    if polygons is None or key not in df.columns:
        return df.withColumn("flag_fuera_de_poligono", F.lit(False))
    heads, strips = polygon_strips(polygons, polygon_key)
    headed = df.join(heads, F.col(key) == F.col("__key"), "left")
    headed = headed.withColumn("__at", strip(F.col("lat")))
    joined = headed.join(strips, (F.col("__key") == F.col("__k")) & (F.col("__at") == F.col("__strip")), "left")
    outside = F.col("__strips").isNotNull() & ~F.coalesce(edges_contain(F.col("__edges"), F.col("lon"), F.col("lat")), F.lit(False))
    return joined.withColumn("flag_fuera_de_poligono", outside).drop("__key", "__y0", "__strips", "__height", "__at", "__k", "__strip", "__edges")


def deduplicated(df: DataFrame, id_col: str, updated: str | None = None) -> DataFrame:
    """One row for each id (null ids are one): the latest by `updated`, then the most complete, then the least by all columns.

    A minimum over structs, which is computed partly before the shuffle: a hot id is one row a task.
    """
    complete = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns])
    order = []
    if updated and updated in df.columns:
        # the latest first, none last
        order = [F.struct(F.col(updated).isNull().alias("none"), (-F.unix_micros(F.col(updated).cast("timestamp"))).alias("t")).alias("age")]
    best = F.min(F.struct(*order, (-complete).alias("c"), *[F.struct(F.col(f"`{c}`").isNull().alias("none"), F.col(f"`{c}`").alias("v")).alias(f"k{i}") for i, c in enumerate(df.columns)]))
    out = df.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(best.alias("__b"))
    return out.select(*[F.col(f"__b.k{i}.v").alias(c) for i, c in enumerate(df.columns)])


def reencoded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with mis-decoded cells of these columns repaired and q_cells, the number of them in the row."""
    have = [c for c in columns if c in df.columns]
    fixed = {c: repaired(F.col(c)) for c in have}
    count = reduce(lambda a, b: a + b, [F.coalesce((v != F.col(c)).cast("int"), F.lit(0)) for c, v in fixed.items()], F.lit(0))
    return df.withColumn("q_cells", count).withColumns(fixed)


def validated(df: DataFrame, id_col: str, text_cols: Sequence[str] | None = None, updated: str | None = None, key: str | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """The rows that all rules leave, corrected and flagged."""
    return _chain(df, id_col, text_cols, updated, key, polygons)[1].drop("q_swapped", "q_cells")


def _chain(df: DataFrame, id_col: str, text_cols: Sequence[str] | None, updated: str | None, key: str | None, polygons: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    text_cols = [c for c, t in df.dtypes if t == "string"] if text_cols is None else text_cols
    status = with_status(df)
    kept = status.filter(~F.col("q_missing") & ~F.col("q_outside")).drop("q_missing", "q_outside", "q_swapped")
    flagged = flag_outside_polygon(kept, polygons, key or "")
    return status, reencoded(deduplicated(flagged, id_col, updated), text_cols)


def quality_report(df: DataFrame, dataset: str, id_col: str, text_cols: Sequence[str] | None = None, updated: str | None = None, key: str | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """One row: dataset, n_registros_inicial, n_registros_final, reglas (array of struct regla, accion, registros_afectados, nota)."""
    status, last = _chain(df, id_col, text_cols, updated, key, polygons)
    flagged = flag_outside_polygon(status.filter(~F.col("q_missing") & ~F.col("q_outside")), polygons, key or "")
    first = status.agg(F.count("*").alias("n0"), *[F.count_if(f"q_{c}").alias(c) for c in ("missing", "swapped", "outside")])
    middle = flagged.agg(F.count("*").alias("n1"), F.count_if("flag_fuera_de_poligono").alias("flags"))
    end = last.agg(F.count("*").alias("n2"), F.coalesce(F.sum("q_cells"), F.lit(0)).alias("cells"))
    note = F.when(F.lit(polygons is None or (key or "") not in df.columns), F.lit(NO_POLYGONS))
    counts = ["missing", "swapped", "outside", "flags", F.col("n1") - F.col("n2"), "cells"]
    rules = [
        F.struct(F.lit(rule).alias("regla"), F.lit(action).alias("accion"), (F.col(n) if isinstance(n, str) else n).cast("long").alias("registros_afectados"), (note if "poligono" in rule else F.lit(None).cast("string")).alias("nota"))
        for (rule, action), n in zip(RULES, counts, strict=True)
    ]
    one = first.crossJoin(middle).crossJoin(end)  # three single rows
    return one.select(F.lit(dataset).alias("dataset"), F.col("n0").alias("n_registros_inicial"), F.col("n2").alias("n_registros_final"), F.array(*rules).alias("reglas"))


def flat_report(reports: DataFrame) -> DataFrame:
    """One row for each dataset and rule."""
    return reports.select("dataset", F.explode("reglas").alias("r")).select("dataset", "r.regla", "r.accion", "r.registros_afectados")


def report_pivot(reports: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Affected rows by rule, a column for each dataset; 0 where a dataset has none."""
    return flat_report(reports).groupBy("regla").pivot("dataset", list(datasets)).agg(F.first("registros_afectados")).fillna(0)


def with_category(df: DataFrame, col: str = "categoria") -> DataFrame:
    """df with its category in canonical spelling and resolutivo: whether that is one with surgery."""
    return df.withColumn(col, normalised_category(F.col(col))).withColumn("resolutivo", F.col(col).isin(*config.SURGICAL_CATEGORIES))


def surgical(facilities: DataFrame) -> DataFrame:
    """The active facilities with surgery."""
    return with_category(facilities).filter(F.col("resolutivo") & F.col("activo"))


def candidates(facilities: DataFrame) -> DataFrame:
    """The active facilities without."""
    return with_category(facilities).filter(~F.col("resolutivo") & F.col("activo"))
