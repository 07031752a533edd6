"""Registered queries of the access engine, each with an independent SQL text for the oracle.

Every query runs an operator over whole tables through the fixtures. Aggregated doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachway import config
from reachway.functions import geo, text
from reachway.operators import access, graph, modes, population, quality, scenario
from reachway.plans.fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns or [c for c, t in df.dtypes if t == "double"]})


# --- the parts that most queries share, in Spark and in SQL


def _surgical(spark: SparkSession, d: str) -> DataFrame:
    return quality.surgical(fixture(spark, d, "fx_facility"))


def _matrix(spark: SparkSession, d: str, profile: str | None = "drive") -> DataFrame:
    m = fixture(spark, d, "fx_matrix")
    m = m if profile is None else m.filter(F.col("profile") == profile).drop("profile")
    return m.join(_surgical(spark, d).select("facility_id"), "facility_id", "left_semi")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Demand with its best time; no route gives a null time and counts as estimated."""
    best = modes.nearest_facility(_matrix(spark, d)).select("cp_id", "t_min")
    return fixture(spark, d, "fx_demand").join(best, "cp_id", "left").withColumn("t_min_estimado", F.col("t_min").isNull())


_CATEGORY = "CASE trim(coalesce(categoria, 'None')) WHEN 'ii-1' THEN 'II-1' WHEN 'II–1' THEN 'II-1' WHEN 'II_1' THEN 'II-1' ELSE trim(coalesce(categoria, 'None')) END"
_IN = "('II-1', 'II-2', 'II-E', 'III-1', 'III-2', 'III-E')"
_OK = f", ok AS (SELECT * FROM fx_facility WHERE activo AND {_CATEGORY} IN {_IN})"
_DRIVE = _OK + ", drive AS (SELECT cp_id, facility_id, t_min FROM fx_matrix WHERE profile = 'drive' AND facility_id IN (SELECT facility_id FROM ok))"
_BEST = _DRIVE + ", best AS (SELECT cp_id, facility_id, t_min FROM (SELECT *, row_number() OVER (PARTITION BY cp_id ORDER BY t_min, facility_id) AS rn FROM drive WHERE t_min IS NOT NULL) WHERE rn = 1)"
_DM = _BEST + ", dm AS (SELECT fx_demand.*, best.t_min, best.t_min IS NULL AS t_min_estimado FROM fx_demand LEFT JOIN best USING (cp_id))"
_ALL = ("fx_demand", "fx_facility", "fx_matrix")


def _sql(body: str, *names: str) -> str:
    return with_fixtures(body, *(names or _ALL))


def _by(group: str, source: str = "dm") -> str:
    return f"""SELECT {group}, round(sum(t_min * poblacion) FILTER (t_min IS NOT NULL) / nullif(sum(poblacion) FILTER (t_min IS NOT NULL), 0), 6) AS t_min_ponderado,
 round(100.0 * coalesce(sum(poblacion) FILTER (t_min_estimado), 0) / nullif(sum(poblacion), 0), 6) AS pct_estimado FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}"""


# --- access measures


def _access(group: str) -> None:
    _query(f"access_by_{group}", _sql(_DM + " " + _by(group)))(lambda s, d: _rounded(access.weighted_mean_access(_points(s, d), group)))


for _group in ("departamento", "provincia", "distrito"):
    _access(_group)


@_query("critical_districts", _sql(_DM + f" SELECT * FROM ({_by('distrito')}) ORDER BY t_min_ponderado DESC NULLS LAST, distrito LIMIT 10"))
def critical_districts(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.critical_districts(_points(s, d)))


@_query(
    "coverage_bands",
    _sql(_DM + """, b AS (
 SELECT *, CASE WHEN t_min IS NULL THEN 'Sin ruta (sin facility en el departamento)' WHEN t_min < 0 THEN NULL WHEN t_min <= 30 THEN '<= 30 min' WHEN t_min <= 60 THEN '<= 60 min' WHEN t_min <= 120 THEN '<= 120 min' ELSE '> 120 min' END AS banda FROM dm)
SELECT banda, CAST(sum(poblacion) AS BIGINT) AS poblacion, round(100.0 * sum(poblacion) / sum(sum(poblacion)) OVER (), 6) AS pct_poblacion,
 round(100.0 * coalesce(sum(poblacion) FILTER (t_min_estimado), 0) / nullif(sum(poblacion), 0), 6) AS pct_estimado_por_desvio FROM b WHERE banda IS NOT NULL GROUP BY banda"""),
)
def coverage_bands(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.coverage_bands(_points(s, d)))


@_query("urban_rural_contrast", _sql(_DM + ", u AS (SELECT *, coalesce(poblacion >= 2000, false) AS es_urbano FROM dm) " + _by("es_urbano", "u")))
def urban_rural_contrast(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.urban_rural_contrast(_points(s, d)))


@_query(
    "gini_weighted",
    _sql(_DM + """, g AS (SELECT t_min AS v, CAST(poblacion AS DOUBLE) AS w, sum(t_min * poblacion) OVER (ORDER BY t_min, cp_id ROWS UNBOUNDED PRECEDING) AS cx FROM dm WHERE t_min IS NOT NULL)
SELECT round(1 - sum((2 * cx - v * w) * w) / (sum(v * w) * sum(w)), 9) AS gini FROM g"""),
)
def gini_weighted(s: SparkSession, d: str) -> DataFrame:
    return access.gini_weighted(_points(s, d)).select(F.round("gini", 9).alias("gini"))


@_query(
    "altitude_access_cross",
    _sql(_DM + """, r AS (SELECT altitud_m AS x, t_min AS y, CAST(poblacion AS DOUBLE) AS w FROM dm WHERE altitud_m IS NOT NULL AND t_min IS NOT NULL),
m AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM r),
c AS (SELECT sum(w * (x - mx) * (y - my)) AS xy, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (y - my) * (y - my)) AS yy, max(n) AS n FROM r, m)
SELECT round(xy / sqrt(xx * yy), 9) AS r_ponderado, round(xy / xx, 9) AS pendiente_min_por_metro, n FROM c"""),
)
def altitude_access_cross(s: SparkSession, d: str) -> DataFrame:
    out = access.altitude_access_cross(_points(s, d))
    return out.select(F.round("r_ponderado", 9).alias("r_ponderado"), F.round("pendiente_min_por_metro", 9).alias("pendiente_min_por_metro"), "n")


@_query(
    "sfca_2step",
    _sql(_DRIVE + """, near AS (SELECT cp_id, facility_id, poblacion FROM drive JOIN fx_demand USING (cp_id) WHERE t_min <= 60),
rj AS (SELECT facility_id, max(capacidad) / nullif(CAST(sum(poblacion) AS DOUBLE), 0) AS r FROM near JOIN ok USING (facility_id) GROUP BY facility_id)
SELECT fx_demand.cp_id, round(coalesce(sum(r), 0), 9) AS accesibilidad_2sfca FROM fx_demand LEFT JOIN near USING (cp_id) LEFT JOIN rj USING (facility_id) GROUP BY fx_demand.cp_id"""),
)
def sfca_2step(s: SparkSession, d: str) -> DataFrame:
    out = access.two_step_floating_catchment(_matrix(s, d), fixture(s, d, "fx_demand"), _surgical(s, d))
    return out.select("cp_id", F.round("accesibilidad_2sfca", 9).alias("accesibilidad_2sfca"))


# --- modes and straight lines

_MODES = _OK + """, a AS (SELECT *, row_number() OVER (PARTITION BY profile, cp_id ORDER BY t_min, facility_id) AS rn FROM fx_matrix WHERE t_min IS NOT NULL AND facility_id IN (SELECT facility_id FROM ok)),
mc AS (SELECT d.cp_id, d.facility_id AS facility_drive, d.t_min AS t_min_drive, w.facility_id AS facility_walk, w.t_min AS t_min_walk, w.facility_id IS DISTINCT FROM d.facility_id AS facility_cambia_walk, w.t_min / nullif(d.t_min, 0) AS ratio_walk_drive,
 b.facility_id AS facility_bike, b.t_min AS t_min_bike, b.facility_id IS DISTINCT FROM d.facility_id AS facility_cambia_bike, b.t_min / nullif(d.t_min, 0) AS ratio_bike_drive
 FROM (SELECT * FROM a WHERE rn = 1 AND profile = 'drive') d LEFT JOIN (SELECT * FROM a WHERE rn = 1 AND profile = 'walk') w USING (cp_id) LEFT JOIN (SELECT * FROM a WHERE rn = 1 AND profile = 'bike') b USING (cp_id))"""
_RATIOS = ("ratio_walk_drive", "ratio_bike_drive")


def _comparison(s: SparkSession, d: str) -> DataFrame:
    return modes.compare_modes(_matrix(s, d, None))


@_query("mode_comparison", _sql(_MODES + " SELECT * REPLACE (round(ratio_walk_drive, 6) AS ratio_walk_drive, round(ratio_bike_drive, 6) AS ratio_bike_drive) FROM mc", "fx_facility", "fx_matrix"))
def mode_comparison(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_comparison(s, d), *_RATIOS)


@_query(
    "mode_ratio_summary",
    _sql(_MODES + " " + " UNION ALL ".join(f"SELECT '{c}' AS perfil, round(avg({c}), 6) AS mean, round(median({c}), 6) AS mediana, round(max({c}), 6) AS max FROM mc WHERE {c} IS NOT NULL" for c in _RATIOS), "fx_facility", "fx_matrix"),
)
def mode_ratio_summary(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.describe(_comparison(s, d), _RATIOS))


@_query("mode_ratio_by_departamento", _sql(_MODES + " SELECT departamento, round(median(ratio_walk_drive), 6) AS ratio_walk_drive, round(median(ratio_bike_drive), 6) AS ratio_bike_drive FROM mc JOIN fx_demand USING (cp_id) GROUP BY departamento"))
def mode_ratio_by_departamento(s: SparkSession, d: str) -> DataFrame:
    joined = _comparison(s, d).join(fixture(s, d, "fx_demand").select("cp_id", "departamento"), "cp_id", "left")
    return _rounded(access.medians_by(joined, "departamento", _RATIOS))


@_query("box_quartiles", _sql(_MODES + " " + " UNION ALL ".join(f"SELECT '{c}' AS perfil, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS mediana, round(quantile_cont({c}, 0.75), 6) AS q3 FROM mc" for c in _RATIOS), "fx_facility", "fx_matrix"))
def box_quartiles(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.quartiles(_comparison(s, d), _RATIOS))


_STRAIGHT = _BEST + """, dist AS (SELECT d.cp_id, d.departamento, f.facility_id, sqrt((f.lon - d.lon) * (f.lon - d.lon) + (f.lat - d.lat) * (f.lat - d.lat)) AS dd FROM fx_demand d, ok f),
st AS (SELECT cp_id, departamento, facility_id AS facility_recta, dd AS dist_recta_m FROM (SELECT *, row_number() OVER (PARTITION BY cp_id ORDER BY dd, facility_id) AS rn FROM dist) WHERE rn = 1),
svn AS (SELECT st.cp_id, st.departamento, facility_recta, dist_recta_m, best.facility_id AS facility_red, best.t_min AS t_min_red, facility_recta = best.facility_id AS coincide, l.t_min AS t_min_si_recta, l.t_min - best.t_min AS penalidad_min
 FROM st JOIN best USING (cp_id) LEFT JOIN drive l ON l.cp_id = st.cp_id AND l.facility_id = st.facility_recta)"""


def _svn(s: SparkSession, d: str) -> DataFrame:
    return modes.straight_vs_network(_matrix(s, d), fixture(s, d, "fx_demand"), _surgical(s, d), planar=True)


@_query("straight_vs_network", _sql(_STRAIGHT + " SELECT cp_id, facility_recta, round(dist_recta_m, 6) AS dist_recta_m, facility_red, t_min_red, coincide, t_min_si_recta, round(penalidad_min, 6) AS penalidad_min FROM svn"))
def straight_vs_network(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_svn(s, d), "dist_recta_m", "penalidad_min")


@_query("straight_vs_network_summary", _sql(_STRAIGHT + " SELECT departamento, round(100 * avg(CASE WHEN coincide THEN 0.0 ELSE 1.0 END), 6) AS pct_facility_distinta, round(median(penalidad_min) FILTER (NOT coincide), 6) AS penalidad_min_mediana FROM svn GROUP BY departamento"))
def straight_vs_network_summary(s: SparkSession, d: str) -> DataFrame:
    svn = _svn(s, d).join(fixture(s, d, "fx_demand").select("cp_id", "departamento"), "cp_id")
    return _rounded(modes.straight_vs_network_summary(svn, "departamento"))


@_query("circuity_factor", _sql(_STRAIGHT + " SELECT departamento, round(coalesce(median(t_min_red / nullif(dist_recta_m / 500e0, 0)), 1.3), 6) AS factor_desvio FROM svn GROUP BY departamento"))
def circuity_factor(s: SparkSession, d: str) -> DataFrame:
    svn = _svn(s, d).join(fixture(s, d, "fx_demand").select("cp_id", "departamento"), "cp_id")
    return _rounded(modes.circuity_factor(svn, "departamento"))


_FACTOR = _STRAIGHT + ", factor AS (SELECT coalesce(median(t_min_red / nullif(dist_recta_m / 500e0, 0)), 1.3) AS f FROM svn)"


@_query("fallback_times", _sql(_FACTOR + " SELECT cp_id, facility_recta AS facility_id_fallback, round(dist_recta_m, 6) AS dist_recta_m_fallback, round(dist_recta_m / 500e0 * f, 6) AS t_min_fallback FROM st, factor"))
def fallback_times(s: SparkSession, d: str) -> DataFrame:
    return _rounded(modes.fallback_times(fixture(s, d, "fx_demand"), _surgical(s, d), modes.circuity_factor(_svn(s, d)), planar=True))


@_query("demanda_metrics", _sql(_FACTOR + " SELECT cp_id, poblacion, coalesce(best.facility_id, facility_recta) AS facility_mas_cercana, round(coalesce(best.t_min, dist_recta_m / 500e0 * f), 6) AS t_min, best.t_min IS NULL AS t_min_estimado FROM fx_demand LEFT JOIN best USING (cp_id) JOIN st USING (cp_id), factor"))
def demanda_metrics(s: SparkSession, d: str) -> DataFrame:
    out = modes.demand_metrics(_matrix(s, d), fixture(s, d, "fx_demand"), _surgical(s, d), planar=True)
    return _rounded(out.select("cp_id", "poblacion", "facility_mas_cercana", "t_min", "t_min_estimado"), "t_min")


# --- the same in metres, in the UTM zone of all points' mean

_EAST_M, _NORTH_M = geo.utm_sql("lon", "lat", "zone", "south")
_METRES = f""", zone AS (SELECT floor((avg(lon) + 180e0) / 6e0) + 1 AS zone, avg(lat) < 0 AS south FROM (SELECT lon, lat FROM fx_demand UNION ALL SELECT lon, lat FROM ok)),
dp AS (SELECT cp_id, departamento, {_EAST_M} AS x, {_NORTH_M} AS y FROM fx_demand, zone), fp AS (SELECT facility_id, {_EAST_M} AS x, {_NORTH_M} AS y FROM ok, zone)"""
_STRAIGHT_M = _BEST + _METRES + _STRAIGHT[len(_BEST):].replace("fx_demand d, ok f", "dp d, fp f").replace("f.lon - d.lon", "f.x - d.x").replace("f.lat - d.lat", "f.y - d.y")
_FACTOR_M = _FACTOR.replace(_STRAIGHT, _STRAIGHT_M)


@_query("straight_vs_network_metric", _sql(_STRAIGHT_M + " SELECT cp_id, facility_recta, round(dist_recta_m, 3) AS dist_recta_m, facility_red, t_min_red, coincide, t_min_si_recta, round(penalidad_min, 6) AS penalidad_min FROM svn"))
def straight_vs_network_metric(s: SparkSession, d: str) -> DataFrame:
    out = modes.straight_vs_network(_matrix(s, d), fixture(s, d, "fx_demand"), _surgical(s, d))
    return out.withColumns({"dist_recta_m": F.round("dist_recta_m", 3), "penalidad_min": F.round("penalidad_min", 6)})


@_query("demanda_metrics_metric", _sql(_FACTOR_M + " SELECT cp_id, poblacion, coalesce(best.facility_id, facility_recta) AS facility_mas_cercana, round(coalesce(best.t_min, dist_recta_m / 500e0 * f), 4) AS t_min, best.t_min IS NULL AS t_min_estimado FROM fx_demand LEFT JOIN best USING (cp_id) JOIN st USING (cp_id), factor"))
def demanda_metrics_metric(s: SparkSession, d: str) -> DataFrame:
    out = modes.demand_metrics(_matrix(s, d), fixture(s, d, "fx_demand"), _surgical(s, d))
    return out.select("cp_id", "poblacion", "facility_mas_cercana", F.round("t_min", 4).alias("t_min"), "t_min_estimado")


# --- data quality

_BOX_SQL = "({0} BETWEEN -81.4e0 AND -68.6e0 AND {1} BETWEEN -18.4e0 AND -0.04e0)"
_STATUS = f""", q AS (SELECT *, lon IS NULL OR lat IS NULL OR (lon = 0 AND lat = 0) AS gone, coalesce({_BOX_SQL.format('lon', 'lat')}, false) AS inside, coalesce({_BOX_SQL.format('lat', 'lon')}, false) AS inverse FROM fx_demand_raw),
qs AS (SELECT cp_id, nombre, poblacion, departamento, provincia, distrito, gone, NOT gone AND NOT inside AND inverse AS swapped, NOT gone AND NOT inside AND NOT inverse AS outside,
 CASE WHEN NOT gone AND NOT inside AND inverse THEN lat ELSE lon END AS lon, CASE WHEN NOT gone AND NOT inside AND inverse THEN lon ELSE lat END AS lat FROM q)"""
_RAW = ("fx_demand_raw",)
_COLS = "cp_id, nombre, poblacion, departamento, provincia, distrito, lon, lat"


def _raw(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "fx_demand_raw")


@_query("dq_missing_coords", _sql(f"SELECT {_COLS} FROM fx_demand_raw WHERE NOT (lon IS NULL OR lat IS NULL OR (lon = 0 AND lat = 0))", *_RAW))
def dq_missing_coords(s: SparkSession, d: str) -> DataFrame:
    return quality.drop_missing(_raw(s, d))


@_query("dq_swap", _sql(_STATUS + f" SELECT {_COLS} FROM qs", *_RAW))
def dq_swap(s: SparkSession, d: str) -> DataFrame:
    return quality.unswap(_raw(s, d))


@_query("dq_bbox", _sql(f"SELECT {_COLS} FROM fx_demand_raw WHERE {_BOX_SQL.format('lon', 'lat')}", *_RAW))
def dq_bbox(s: SparkSession, d: str) -> DataFrame:
    return quality.drop_outside(_raw(s, d))


_DEDUP = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cp_id ORDER BY (nombre IS NULL)::INT + (lon IS NULL)::INT + (lat IS NULL)::INT, nombre) AS rn FROM {0}) WHERE rn = 1"


@_query("dq_dedup", _sql(" " + _DEDUP.format("fx_demand_raw"), *_RAW))
def dq_dedup(s: SparkSession, d: str) -> DataFrame:
    return quality.deduplicated(_raw(s, d), "cp_id")


_REPORT = _STATUS + """, k AS (SELECT * FROM qs WHERE NOT gone AND NOT outside), rep AS (
 SELECT 'coordenadas_nulas_o_cero' AS regla, 'drop' AS accion, count(*) FILTER (gone) AS registros_afectados FROM qs UNION ALL
 SELECT 'lat_lon_invertidos', 'swap_si_cae_en_bbox', count(*) FILTER (swapped) FROM qs UNION ALL SELECT 'fuera_de_bbox_peru', 'drop', count(*) FILTER (outside) FROM qs UNION ALL
 SELECT 'punto_fuera_de_poligono_distrital', 'flag', 0 UNION ALL SELECT 'codigos_duplicados', 'dedup_keep_mas_completo_o_reciente', count(*) - count(DISTINCT cp_id) FROM k UNION ALL
 SELECT 'encoding_utf8_vs_latin1', 'reencode_donde_aplica', 0)"""


@_query("dq_report", _sql(_REPORT + " SELECT 'demanda' AS dataset, regla, accion, CAST(registros_afectados AS BIGINT) AS registros_afectados, (SELECT count(*) FROM qs) AS n_registros_inicial, (SELECT count(DISTINCT cp_id) FROM k) AS n_registros_final FROM rep", *_RAW))
def dq_report(s: SparkSession, d: str) -> DataFrame:
    r = quality.quality_report(_raw(s, d), "demanda", "cp_id")
    return r.select("dataset", F.inline("reglas"), "n_registros_inicial", "n_registros_final").drop("nota")


@_query("report_flatten", _sql(_REPORT + " SELECT 'demanda' AS dataset, regla, accion, CAST(registros_afectados AS BIGINT) AS registros_afectados FROM rep", *_RAW))
def report_flatten(s: SparkSession, d: str) -> DataFrame:
    return quality.flat_report(quality.quality_report(_raw(s, d), "demanda", "cp_id"))


_TYPED = ", t AS (SELECT regla, CAST(registros_afectados AS BIGINT) AS demanda FROM rep)"


@_query("quality_pivot", _sql(_REPORT + _TYPED + """ SELECT regla, demanda, CAST(0 AS BIGINT) AS limpia FROM t""", *_RAW))
def quality_pivot(s: SparkSession, d: str) -> DataFrame:
    clean = fixture(s, d, "fx_demand").drop("altitud_m")
    reports = quality.quality_report(_raw(s, d), "demanda", "cp_id").unionByName(quality.quality_report(clean, "limpia", "cp_id"))
    return quality.report_pivot(reports, ["demanda", "limpia"])


@_query("dq_validated", _sql(_STATUS + ", k AS (SELECT * FROM qs WHERE NOT gone AND NOT outside), u AS (" + _DEDUP.format("k") + f") SELECT {_COLS}, false AS flag_fuera_de_poligono FROM u", *_RAW))
def dq_validated(s: SparkSession, d: str) -> DataFrame:
    return quality.validated(_raw(s, d), "cp_id")


@_query("dq_polygon", _sql(" SELECT cp_id, x0 IS NOT NULL AND NOT (lon > x0 AND lon < x1 AND lat > y0 AND lat < y1) AS flag_fuera_de_poligono FROM fx_demand LEFT JOIN fx_polygon USING (provincia)", "fx_demand", "fx_polygon"))
def dq_polygon(s: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = fixture(s, d, "fx_polygon").select("provincia", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))
    return quality.flag_outside_polygon(fixture(s, d, "fx_demand"), rings, "provincia", "provincia").select("cp_id", "flag_fuera_de_poligono")


# every province has a mainland with a lake and an island to the east of it
_LAND, _LAKE, _ISLE = ("x0", "x1", "y0", "y1"), ("x0 + 2e0", "x0 + 4e0", "-12e0", "-8e0"), ("x1 + 0.5e0", "x1 + 1.5e0", "-10e0", "-6e0")


def polygon_parts(s: SparkSession, d: str) -> DataFrame:
    """provincia and rings: mainland, lake, island."""

    def ring(x0: str, x1: str, y0: str, y1: str) -> Column:
        return F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])

    return fixture(s, d, "fx_polygon").select("provincia", F.array(ring(*_LAND), ring(*_LAKE), ring(*_ISLE)).alias("rings"))


def _within(box: tuple[str, str, str, str], closed: bool = False) -> str:
    less = "<=" if closed else "<"
    return f"({box[0]} {less} lon AND lon {less} {box[1]} AND {box[2]} {less} lat AND lat {less} {box[3]})"


PARTS_SQL = f"x0 IS NOT NULL AND NOT (({_within(_LAND)} AND NOT {_within(_LAKE, True)}) OR {_within(_ISLE)})"


@_query("dq_polygon_parts", _sql(f" SELECT cp_id, {PARTS_SQL} AS flag_fuera_de_poligono FROM fx_demand LEFT JOIN fx_polygon USING (provincia)", "fx_demand", "fx_polygon"))
def dq_polygon_parts(s: SparkSession, d: str) -> DataFrame:
    return quality.flag_outside_polygon(fixture(s, d, "fx_demand"), polygon_parts(s, d), "provincia", "provincia").select("cp_id", "flag_fuera_de_poligono")


@_query("normalize_categoria", _sql(f" SELECT facility_id, {_CATEGORY} AS categoria, {_CATEGORY} IN {_IN} AS resolutivo FROM fx_facility", "fx_facility"))
def normalize_categoria(s: SparkSession, d: str) -> DataFrame:
    return quality.with_category(fixture(s, d, "fx_facility")).select("facility_id", "categoria", "resolutivo")


# --- text and numbers: the cases are hung on the rows of nation, so that the oracle reads a table too

_MOJIBAKE = ["MuÃ±oz", "CÃ³rdova", "Áncash", "Lima", "日本", "Ã", "", "niÃ±o y niña"]
_FIXED = ["Muñoz", "Córdova", "Áncash", "Lima", "日本", "Ã", "", "niÃ±o y niña"]
_NAMES = [" Huaytará ", "CÓRDOVA", "Ñuñoa", "san josé", "", "Güepí", "Šiauliai", "Žilina", "Ştefan vodă", "Łódź", "Đakovo", "n\u0303an\u0303a", "Ángström å"]
_SPEEDS = ["50", "50 km/h", "30 mph", "none", "", "  80;60", "0", "12.5 MPH"]
_ROADS = ["motorway", "residential", "track", "unknown", "primary_link", "road", "service", "trunk"]
_NUMBERS = ["1.5", " 2 ", "abc", "", "NaN", "-3e2", "1234567", "10"]


def _cases(s: SparkSession, d: str, **columns: list[str]) -> DataFrame:
    """One row of nation for each case: the nation's key picks it."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    return n.select("k", *[F.element_at(F.array(*map(F.lit, v)), (F.col("k") % len(v) + 1).cast("int")).alias(c) for c, v in columns.items()])


def _cases_sql(**columns: list[str]) -> str:
    quoted = {c: ", ".join("'" + x.replace("'", "''") + "'" for x in v) for c, v in columns.items()}
    return "(SELECT CAST(n_nationkey AS BIGINT) AS k, " + ", ".join(f"([{q}])[CAST(n_nationkey % {len(columns[c])} + 1 AS INT)] AS {c}" for c, q in quoted.items()) + " FROM nation)"


@_query("dq_encoding", f"SELECT k, wanted AS repaired FROM {_cases_sql(raw=_MOJIBAKE, wanted=_FIXED)}")
def dq_encoding(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, raw=_MOJIBAKE).select("k", text.repaired(F.col("raw")).alias("repaired"))


@_query("norm_name", f"SELECT k, strip_accents(upper(trim(raw))) AS name FROM {_cases_sql(raw=_NAMES)}")
def norm_name(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, raw=_NAMES).select("k", text.norm_name(F.col("raw")).alias("name"))


_MAXSPEED = r"try_cast(nullif(regexp_extract(lower(trim(raw)), '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) * CASE WHEN lower(raw) LIKE '%mph%' THEN 1.60934e0 ELSE 1e0 END"


@_query("maxspeed_parse", f"SELECT k, round({_MAXSPEED}, 6) AS kmh FROM {_cases_sql(raw=_SPEEDS)}")
def maxspeed_parse(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, raw=_SPEEDS).select("k", F.round(text.maxspeed_kmh(F.col("raw")), 6).alias("kmh"))


_HIGHWAY = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.HIGHWAY_SPEED_KMH.items()) + " END"
_DRIVABLE = "(" + ", ".join(f"'{h}'" for h in config.DRIVE_HIGHWAYS) + ")"


@_query(
    "edge_travel_time",
    f"WITH e AS (SELECT k AS src, k + 1 AS dst, CAST(k * 100 AS DOUBLE) AS length, highway, raw FROM {_cases_sql(highway=_ROADS, raw=_SPEEDS[:-1])}) "
    f"SELECT 'drive' AS profile, src, dst, length, round(length / nullif(coalesce({_MAXSPEED}, {_HIGHWAY}, 30e0) * 1000 / 3600, 0), 6) AS travel_time FROM e WHERE highway IN {_DRIVABLE} "
    + "".join(f"UNION ALL SELECT '{p}', src, dst, length, round(length / ({v}e0 * 1000 / 3600), 6) FROM e WHERE highway NOT IN ('motorway', 'motorway_link') " for p, v in (("walk", 5), ("bike", 15))),
)
def edge_travel_time(s: SparkSession, d: str) -> DataFrame:
    raw = _cases(s, d, highway=_ROADS, maxspeed=_SPEEDS[:-1]).select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"), (F.col("k") * 100).cast("double").alias("length"), "highway", "maxspeed")
    out = None
    for p in config.PROFILES:
        part = graph.profile_edges(raw, p).select(F.lit(p).alias("profile"), "*")
        out = part if out is None else out.unionByName(part)
    return _rounded(out, "travel_time")


@_query(
    "coerce_zfill_round",
    f"SELECT k, CASE WHEN isnan(try_cast(trim(raw) AS DOUBLE)) THEN NULL ELSE try_cast(trim(raw) AS DOUBLE) END AS number, CASE WHEN length(raw) < 6 THEN lpad(raw, 6, '0') ELSE raw END AS code, CAST(round_even(k / 2e0, 0) AS BIGINT) AS half FROM {_cases_sql(raw=_NUMBERS)}",
)
def coerce_zfill_round(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d, raw=_NUMBERS).select("k", text.to_number(F.col("raw")).alias("number"), text.zero_padded(F.col("raw")).alias("code"), text.half_even_count(F.col("k") / 2).alias("half"))


# --- population and samples


@_query(
    "population_share",
    """WITH c AS (SELECT c_custkey AS cp_id, r_name AS departamento, n_name AS provincia, c_mktsegment AS distrito, CAST(1 + c_custkey % 5 AS BIGINT) AS peso FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT departamento, provincia, distrito, CAST(1000 + 7 * count(*) AS BIGINT) AS total FROM c WHERE distrito <> 'BUILDING' GROUP BY ALL)
SELECT cp_id, coalesce(CAST(round_even(CAST(peso AS DOUBLE) / sum(peso) OVER (PARTITION BY departamento, provincia, distrito) * total, 0) AS BIGINT), 0) AS poblacion FROM c LEFT JOIN t USING (departamento, provincia, distrito)""",
)
def population_share(s: SparkSession, d: str) -> DataFrame:
    t = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "nation", "region")}
    c = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("c_custkey").alias("cp_id"), F.col("r_name").alias("departamento"), F.col("n_name").alias("provincia"), F.col("c_mktsegment").alias("distrito"), (1 + F.col("c_custkey") % 5).cast("long").alias("peso"))
    totals = c.filter("distrito <> 'BUILDING'").groupBy("departamento", "provincia", "distrito").agg((1000 + 7 * F.count("*")).alias("poblacion_distrital"))
    return population.shared_out(c, totals, "peso").select("cp_id", "poblacion")


@_query(
    "stratified_sample_counts",
    _sql(", n AS (SELECT distrito, count(*) AS c, (SELECT count(*) FROM fx_demand) AS total FROM fx_demand GROUP BY distrito) SELECT distrito, CASE WHEN total <= 500 THEN c ELSE least(c, greatest(1, CAST(round_even(c * (500e0 / total), 0) AS BIGINT))) END AS n FROM n", "fx_demand"),
)
def stratified_sample_counts(s: SparkSession, d: str) -> DataFrame:
    return population.stratified_sample(fixture(s, d, "fx_demand"), 500).groupBy("distrito").agg(F.count("*").alias("n"))


@_query(
    "attach_ubigeo",
    _sql(", dis AS (SELECT provincia AS p, printf('%06d', row_number() OVER (ORDER BY provincia)) AS ubigeo FROM fx_polygon) SELECT cp_id, ubigeo, provincia, 'X' AS distrito FROM fx_demand LEFT JOIN dis ON p = provincia", "fx_demand", "fx_polygon"),
)
def attach_ubigeo(s: SparkSession, d: str) -> DataFrame:
    names = fixture(s, d, "fx_polygon").select("provincia")
    before = names.alias("a").join(names.alias("b"), F.col("b.provincia") <= F.col("a.provincia")).groupBy("a.provincia").agg(F.count("*").alias("n"))  # 25 rows
    districts = before.select("provincia", F.lit("X").alias("distrito"), text.zero_padded(F.col("n").cast("string")).alias("ubigeo"))
    settlements = fixture(s, d, "fx_demand").select("cp_id", F.concat(F.lit(" "), F.lower("provincia")).alias("provincia"), F.lit("x").alias("distrito"))
    return population.attach_ubigeo(settlements, districts).select("cp_id", "ubigeo", "provincia", "distrito")


# --- geometry and graphs


@_query("utm_zone", _sql(f" SELECT cp_id, {geo.utm_epsg_sql('lon', 'lat')} AS epsg FROM fx_demand", "fx_demand"))
def utm_zone(s: SparkSession, d: str) -> DataFrame:
    return modes.points_in_zones(fixture(s, d, "fx_demand")).select("cp_id", F.col("utm_epsg").alias("epsg"))


_EAST, _NORTH = geo.utm_sql("lon", "lat", "floor((lon + 180e0) / 6e0) + 1", "lat < 0")


@_query("utm_project", _sql(f" SELECT cp_id, round({_EAST}, 4) AS x, round({_NORTH}, 4) AS y FROM fx_demand", "fx_demand"))
def utm_project(s: SparkSession, d: str) -> DataFrame:
    return modes.points_in_zones(fixture(s, d, "fx_demand")).select("cp_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_SNAPPED = """, p AS (SELECT cp_id, n.node_id, sqrt((n.x - d.lon) * (n.x - d.lon) + (n.y - d.lat) * (n.y - d.lat)) AS dd FROM fx_demand d, fx_nodes n),
sn AS (SELECT cp_id AS id, node_id, round(dd, 6) AS snap_dist_m FROM (SELECT *, row_number() OVER (PARTITION BY cp_id ORDER BY dd, node_id) AS rn FROM p) WHERE rn = 1)"""


def _snapped(s: SparkSession, d: str) -> DataFrame:
    return modes.snap(fixture(s, d, "fx_demand").select(F.col("cp_id").alias("id"), "lon", "lat"), fixture(s, d, "fx_nodes"), planar=True)


@_query("snap_nodes", _sql(_SNAPPED + " SELECT * FROM sn", "fx_demand", "fx_nodes"))
def snap_nodes(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_snapped(s, d))


_SNAPPED_M = f""", zone AS (SELECT floor((avg(x) + 180e0) / 6e0) + 1 AS zone, avg(y) < 0 AS south FROM fx_nodes), np AS (SELECT node_id, {_EAST_M} AS x, {_NORTH_M} AS y FROM (SELECT node_id, x AS lon, y AS lat FROM fx_nodes), zone),
dp AS (SELECT cp_id, {_EAST_M} AS x, {_NORTH_M} AS y FROM fx_demand, zone), p AS (SELECT cp_id, n.node_id, sqrt((n.x - d.x) * (n.x - d.x) + (n.y - d.y) * (n.y - d.y)) AS dd FROM dp d, np n),
sn AS (SELECT cp_id AS id, node_id, round(dd, 3) AS snap_dist_m FROM (SELECT *, row_number() OVER (PARTITION BY cp_id ORDER BY dd, node_id) AS rn FROM p) WHERE rn = 1)"""


@_query("snap_nodes_metric", _sql(_SNAPPED_M + " SELECT * FROM sn", "fx_demand", "fx_nodes"))
def snap_nodes_metric(s: SparkSession, d: str) -> DataFrame:
    out = modes.snap(fixture(s, d, "fx_demand").select(F.col("cp_id").alias("id"), "lon", "lat"), fixture(s, d, "fx_nodes"))
    return out.withColumn("snap_dist_m", F.round("snap_dist_m", 3))


@_query("snap_report", _sql(_SNAPPED + " SELECT count(*) AS n_puntos, round(avg(snap_dist_m), 5) AS snap_dist_m_promedio, max(snap_dist_m) AS snap_dist_m_max, count(*) FILTER (snap_dist_m > 0.2) AS n_sobre_umbral, 0.2e0 AS umbral_metros FROM sn", "fx_demand", "fx_nodes"))
def snap_report(s: SparkSession, d: str) -> DataFrame:
    return modes.snap_report(_rounded(_snapped(s, d)), limit=0.2).withColumn("snap_dist_m_promedio", F.round("snap_dist_m_promedio", 5))


@_query(
    "knn_edges",
    """WITH n AS (SELECT p_partkey AS id, CAST(p_partkey % 20 AS DOUBLE) AS x, floor(p_partkey / 20e0) AS y FROM part),
k AS (SELECT a.id AS src, b.id AS dst, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM n a JOIN n b ON a.id <> b.id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM k)
SELECT src, dst, round(d, 6) AS length FROM r WHERE rn <= 5 UNION ALL SELECT dst, src, round(d, 6) FROM r WHERE rn <= 5""",
)
def knn_edges(s: SparkSession, d: str) -> DataFrame:
    from reachway.sources.synthetic import knn_graph

    nodes = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") % 20).cast("double").alias("x"), F.floor(F.col("p_partkey") / 20).cast("double").alias("y"))
    return _rounded(knn_graph(nodes, 5).select("src", "dst", "length"))


def _routes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, demand (all customers) and facilities (all suppliers) on the nodes of the grid."""
    n = F.broadcast(s.read.parquet(f"{d}/part.parquet").agg(F.count("*").alias("__c")))  # one row
    on = lambda t, key, name, m: s.read.parquet(f"{d}/{t}.parquet").crossJoin(n).select(F.col(key).cast("long").alias(name), (F.col(key) * m % F.col("__c")).cast("long").alias("node_id"))
    return fixture(s, d, "fx_edges"), on("customer", "c_custkey", "cp_id", 11), on("supplier", "s_suppkey", "facility_id", 37)


_GRID = """WITH c AS (SELECT count(*) AS n FROM part), dem AS (SELECT c_custkey AS cp_id, (c_custkey * 11) % n AS a FROM customer, c), fac AS (SELECT s_suppkey AS facility_id, (s_suppkey * 37) % n AS b FROM supplier, c),
dxy AS (SELECT *, b % 20 - a % 20 AS dx, b // 20 - a // 20 AS dy FROM dem, fac)"""
_GRID_S = "60e0 * greatest(dx, 0) + 90e0 * greatest(-dx, 0) + 60e0 * greatest(dy, 0) + 90e0 * greatest(-dy, 0)"


@_query("travel_time_matrix", _GRID + f" SELECT cp_id, facility_id, ({_GRID_S}) / 60e0 AS t_min FROM dxy")
def travel_time_matrix(s: SparkSession, d: str) -> DataFrame:
    return graph.travel_time_matrix(*_routes(s, d))


@_query("matrix_by_joins", _GRID + f" SELECT cp_id, facility_id, ({_GRID_S}) / 60e0 AS t_min FROM dxy")
def matrix_by_joins(s: SparkSession, d: str) -> DataFrame:
    """The whole matrix by the engine for graphs that no worker can hold: delta-stepping, without a limit of time."""
    return graph.travel_time_matrix(*_routes(s, d), engine="relational")


_REACH = """WITH c AS (SELECT count(*) AS n FROM part), fac AS (SELECT s_suppkey AS facility_id, (s_suppkey * 37) % n AS b FROM supplier, c),
dxy AS (SELECT facility_id, p_partkey AS node, b % 20 - p_partkey % 20 AS dx, b // 20 - p_partkey // 20 AS dy FROM part, fac), th(threshold_min) AS (VALUES (5), (10), (20))"""


@_query("isochrone_nodes", _REACH + f" SELECT facility_id, threshold_min, node FROM dxy, th WHERE {_GRID_S} <= threshold_min * 60")
def isochrone_nodes(s: SparkSession, d: str) -> DataFrame:
    edges, _, facilities = _routes(s, d)
    return graph.isochrone_nodes(edges, facilities, (5, 10, 20))


# a hull's sides: pairs of column ends with no column end to the right of them, nor on their line beyond them
_HULL = f""", r AS (SELECT facility_id AS f, threshold_min AS t, node % 20 AS x, node // 20 AS y FROM dxy, th WHERE {_GRID_S} <= threshold_min * 60),
sized AS (SELECT f, t, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 4), ends AS (SELECT f, t, x, min(y) AS y FROM r GROUP BY f, t, x UNION SELECT f, t, x, max(y) FROM r GROUP BY f, t, x),
pairs AS (SELECT p.f, p.t, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM ends p JOIN ends q ON p.f = q.f AND p.t = q.t AND (p.x <> q.x OR p.y <> q.y)),
turns AS (SELECT pairs.*, (qx - px) * (e.y - py) - (qy - py) * (e.x - px) AS turn, (e.x - px) * (e.x - qx) + (e.y - py) * (e.y - qy) AS beyond FROM pairs JOIN ends e ON pairs.f = e.f AND pairs.t = e.t),
sides AS (SELECT f, t, px, py, qx, qy FROM turns GROUP BY ALL HAVING bool_and(turn > 0 OR (turn = 0 AND beyond <= 0)))
SELECT f AS facility_id, t AS threshold_min, n AS n_nodes, round(sum(px * qy - qx * py) / 2e0, 6) AS area, count(*) AS esquinas FROM sides JOIN sized USING (f, t) GROUP BY f, t, n"""


@_query("isochrone_hull", _REACH + _HULL)
def isochrone_hull(s: SparkSession, d: str) -> DataFrame:
    """Polygons over columns and rows of the grid, so that collinear corners are so exactly."""
    edges, _, facilities = _routes(s, d)
    nodes = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("node_id"), (F.col("p_partkey") % 20).cast("double").alias("x"), F.floor(F.col("p_partkey") / 20).cast("double").alias("y"))
    made = graph.isochrones(edges, nodes, facilities, (5, 10, 20))
    corners = F.size(F.split("geometry", ",")) - F.col("geometry").startswith("POLYGON").cast("int")
    return made.select("facility_id", "threshold_min", "n_nodes", F.round("area", 6).alias("area"), corners.cast("long").alias("esquinas"))


# --- the dashboard's questions


@_query(
    "scenario_upgrade",
    _sql(_DM + f""", up AS (SELECT facility_id FROM fx_facility WHERE categoria IN ('I-3', 'I-4')),
b AS (SELECT m.cp_id, m.facility_id, dm.t_min AS t_min_antes, m.t_min AS t_min_despues, row_number() OVER (PARTITION BY m.cp_id ORDER BY m.t_min, m.facility_id) AS rn FROM fx_matrix m JOIN dm USING (cp_id)
 JOIN fx_facility f ON f.facility_id = m.facility_id AND f.activo WHERE m.profile = 'drive' AND m.facility_id IN (SELECT facility_id FROM up) AND m.t_min < dm.t_min)
SELECT cp_id, facility_id, t_min_antes, t_min_despues FROM b WHERE rn = 1"""),
)
def scenario_upgrade(s: SparkSession, d: str) -> DataFrame:
    facilities = fixture(s, d, "fx_facility")
    m = fixture(s, d, "fx_matrix").filter("profile = 'drive'").join(facilities.filter("activo").select("facility_id"), "facility_id", "left_semi")
    return scenario.upgrade(m, _points(s, d), scenario.upgradable(facilities))


@_query(
    "kpi_header",
    _sql(_DM + """ SELECT CAST(sum(poblacion) AS BIGINT) AS poblacion_total, CAST(sum(poblacion) FILTER (t_min <= 60) AS BIGINT) AS poblacion_cubierta, CAST(sum(poblacion) FILTER (t_min > 60 OR t_min IS NULL) AS BIGINT) AS poblacion_mas_60,
 CAST(2 * sum(poblacion) FILTER (t_min IS NULL) AS BIGINT) AS poblacion_estimada, round(median(t_min), 6) AS mediana_acceso, round(100.0 * sum(poblacion) FILTER (t_min <= 60) / sum(poblacion), 6) AS pct_cubierta,
 round(100.0 * sum(poblacion) FILTER (t_min > 60 OR t_min IS NULL) / sum(poblacion), 6) AS pct_mas_60, round(200.0 * sum(poblacion) FILTER (t_min IS NULL) / sum(poblacion), 6) AS pct_estimada FROM dm"""),
)
def kpi_header(s: SparkSession, d: str) -> DataFrame:
    return _rounded(scenario.key_figures(_points(s, d)))


@_query("worst_district", _sql(_DM + f" SELECT distrito, t_min_ponderado FROM ({_by('distrito')}) WHERE t_min_ponderado IS NOT NULL ORDER BY t_min_ponderado DESC, distrito LIMIT 1"))
def worst_district(s: SparkSession, d: str) -> DataFrame:
    return _rounded(scenario.worst_district(_points(s, d)))


@_query("critical_table", _sql(_DM + " SELECT distrito, round(sum(t_min * poblacion) / nullif(sum(poblacion) FILTER (t_min IS NOT NULL), 0), 6) AS t_min_ponderado, CAST(sum(poblacion) AS BIGINT) AS poblacion, round(100.0 * coalesce(sum(poblacion) FILTER (t_min_estimado), 0) / nullif(sum(poblacion), 0), 6) AS pct_estimado_por_desvio FROM dm GROUP BY distrito"))
def critical_table(s: SparkSession, d: str) -> DataFrame:
    return _rounded(scenario.critical_table(_points(s, d)))


@_query(
    "histogram",
    _sql(_DM + """, e AS (SELECT min(t_min) AS lo, (max(t_min) - min(t_min)) / 30 AS w FROM dm), h AS (SELECT departamento, CAST(least(floor((t_min - lo) / w), 29) AS INT) AS bin, lo, w FROM dm, e WHERE t_min IS NOT NULL)
SELECT departamento, bin, count(*) AS n, round(max(lo + bin * w), 6) AS desde FROM h GROUP BY departamento, bin"""),
)
def histogram(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.histogram(_points(s, d), "t_min", 30, ["departamento"]))


@_query("filter_cascade", _sql(_DM + " SELECT provincia, CAST(sum(poblacion) AS BIGINT) AS poblacion, count(*) FILTER (t_min <= 90) AS puntos FROM dm WHERE departamento IN ('AMERICA', 'ASIA') AND provincia IN ('NATION_1', 'NATION_6', 'NATION_2', 'NATION_3') GROUP BY provincia"))
def filter_cascade(s: SparkSession, d: str) -> DataFrame:
    df = scenario.chosen(_points(s, d), departamento=["AMERICA", "ASIA"], provincia=["NATION_1", "NATION_6", "NATION_2", "NATION_3"], distrito=None)
    return df.groupBy("provincia").agg(F.sum("poblacion").alias("poblacion"), F.count_if(F.col("t_min") <= 90).alias("puntos"))


@_query("distinct_lists", _sql(" SELECT DISTINCT 'institucion' AS filtro, institucion AS valor FROM fx_facility UNION ALL SELECT DISTINCT 'categoria', categoria FROM fx_facility UNION ALL SELECT DISTINCT 'departamento', departamento FROM fx_demand", "fx_demand", "fx_facility"))
def distinct_lists(s: SparkSession, d: str) -> DataFrame:
    parts = [scenario.choices(fixture(s, d, t), c).select(F.lit(c).alias("filtro"), F.col(c).alias("valor")) for t, c in (("fx_facility", "institucion"), ("fx_facility", "categoria"), ("fx_demand", "departamento"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("choropleth_join", _sql(_DM + f", a AS ({_by('provincia')}), p AS (SELECT provincia, CAST(sum(poblacion) AS BIGINT) AS poblacion FROM dm GROUP BY provincia) SELECT fx_polygon.provincia, x0, t_min_ponderado, pct_estimado, poblacion FROM fx_polygon LEFT JOIN a USING (provincia) LEFT JOIN p USING (provincia)", *_ALL, "fx_polygon"))
def choropleth_join(s: SparkSession, d: str) -> DataFrame:
    out = scenario.choropleth(fixture(s, d, "fx_polygon").select("provincia", "x0"), _points(s, d), "provincia")
    return _rounded(out, "t_min_ponderado", "pct_estimado")


@_query("histogram_urban", _sql(_DM + """, e AS (SELECT min(t_min) AS lo, (max(t_min) - min(t_min)) / 30 AS w FROM dm), h AS (SELECT coalesce(poblacion >= 2000, false) AS es_urbano, CAST(least(floor((t_min - lo) / w), 29) AS INT) AS bin, lo, w FROM dm, e WHERE t_min IS NOT NULL)
SELECT es_urbano, bin, count(*) AS n, round(max(lo + bin * w), 6) AS desde FROM h GROUP BY es_urbano, bin"""))
def histogram_urban(s: SparkSession, d: str) -> DataFrame:
    return _rounded(access.histogram(_points(s, d).withColumn("es_urbano", access.urban(F.col("poblacion"))), "t_min", 30, ["es_urbano"]))


@_query("map_bounds", _sql(" SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, round((min(lon) + max(lon)) / 2, 6) AS centro_lon, round((min(lat) + max(lat)) / 2, 6) AS centro_lat FROM fx_demand", "fx_demand"))
def map_bounds(s: SparkSession, d: str) -> DataFrame:
    return _rounded(scenario.bounds(fixture(s, d, "fx_demand")), "centro_lon", "centro_lat")


@_query("facility_overlay", _sql(_OK + " SELECT facility_id, count(*) AS pares, count(t_min) AS con_ruta FROM fx_matrix WHERE profile = 'drive' AND facility_id IN (SELECT facility_id FROM ok WHERE institucion IN ('MINSA', 'PRIVADO')) GROUP BY facility_id", "fx_facility", "fx_matrix"))
def facility_overlay(s: SparkSession, d: str) -> DataFrame:
    picked = scenario.chosen(_surgical(s, d), institucion=["MINSA", "PRIVADO"])
    return scenario.overlay(fixture(s, d, "fx_matrix").filter("profile = 'drive'"), picked).groupBy("facility_id").agg(F.count("*").alias("pares"), F.count("t_min").alias("con_ruta"))


@_query("candidate_times", _sql(f""", cand AS (SELECT * FROM fx_facility WHERE activo AND {_CATEGORY} NOT IN {_IN}), m AS (SELECT cp_id, facility_id, t_min, row_number() OVER (PARTITION BY cp_id ORDER BY t_min, facility_id) AS rn FROM fx_matrix WHERE profile = 'drive' AND t_min IS NOT NULL AND facility_id IN (SELECT facility_id FROM cand))
SELECT cp_id, facility_id, t_min FROM m WHERE rn = 1""", "fx_facility", "fx_matrix"))
def candidate_times(s: SparkSession, d: str) -> DataFrame:
    able = quality.candidates(fixture(s, d, "fx_facility"))
    return modes.nearest_facility(scenario.overlay(fixture(s, d, "fx_matrix").filter("profile = 'drive'").drop("profile"), able))


@_query("union_departments", _sql(_BEST + " SELECT cp_id, facility_id, t_min, departamento AS departamento_rol FROM best JOIN fx_demand USING (cp_id)"))
def union_departments(s: SparkSession, d: str) -> DataFrame:
    """Departments as partitions of one Parquet table, read back as one."""
    import uuid

    from reachway.functions.workers import ready
    from reachway.sources.files import read_matrix, write_matrix

    best = modes.nearest_facility(_matrix(s, d)).join(fixture(s, d, "fx_demand").select("cp_id", F.col("departamento").alias("rol")), "cp_id")
    ready(s)
    folder = s.sparkContext.getCheckpointDir() + f"/matrix-{uuid.uuid4().hex}"
    write_matrix(best.select("rol", F.lit("synthetic").alias("source"), F.lit("drive").alias("kind"), "cp_id", "facility_id", "t_min"), folder)
    return read_matrix(s, folder, "synthetic").select("cp_id", "facility_id", "t_min", "departamento_rol")


