"""Readers and writers of the engine's tables: CSV sources, Parquet tables partitioned by role, JSON reports, LaTeX tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachway import config
from reachway.functions.text import capacity, norm_name, to_number
from reachway.functions.workers import bounded
from reachway.operators.population import _plain, district_population

# Columns of the public sources.
FACILITY_COLUMNS = ("COD_IPRESS", "NOMBRE", "CATEGORIA", "INSTITUCION", "ESTADO", "DEPARTAMENTO", "PROVINCIA", "DISTRITO", "UBIGEO", "NORTE", "ESTE")
POPULATION_SCHEMA = "UBIGEO_INEI string, Departamento string, Provincia string, Distrito string, Cantidad long"
REPORT_SCHEMA = "generado_utc string, datasets array<struct<dataset:string,timestamp_utc:string,n_registros_inicial:long,n_registros_final:long,reglas:array<struct<regla:string,accion:string,registros_afectados:long,nota:string>>>>"


def read_facilities(spark: SparkSession, path: str, department: str | None = None) -> DataFrame:
    """Facilities from the national register (semicolons, all text; NORTE and ESTE are latitude and longitude in degrees)."""
    raw = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path).select(*FACILITY_COLUMNS)
    if department is not None:
        raw = raw.filter(norm_name(F.col("DEPARTAMENTO")) == _plain([department])[0])
    lon, lat = to_number(F.col("ESTE")), to_number(F.col("NORTE"))
    both = lon.isNotNull() & lat.isNotNull()
    return raw.select(
        F.col("COD_IPRESS").alias("facility_id"), F.col("NOMBRE").alias("nombre"), F.col("CATEGORIA").alias("categoria"), F.col("INSTITUCION").alias("institucion"), (norm_name(F.col("ESTADO")) == "ACTIVO").alias("activo"),
        F.col("DEPARTAMENTO").alias("departamento"), F.col("PROVINCIA").alias("provincia"), F.col("DISTRITO").alias("distrito"), F.col("UBIGEO").alias("ubigeo"), capacity(F.col("CATEGORIA")).alias("capacidad"),
        F.when(both, lon).alias("lon"), F.when(both, lat).alias("lat"),
    )


def read_population(spark: SparkSession, path: str, departments: Sequence[str] | None = None) -> DataFrame:
    """Population by district. Splits take the place of the chunks in which a large file would be read by hand; columns go by name."""
    raw = spark.read.option("header", True).csv(path)
    kinds = T.StructType.fromDDL(POPULATION_SCHEMA)
    return district_population(raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]), None if departments is None else list(departments))


def settlements(raw: DataFrame, department: str | None = None) -> DataFrame:
    """Populated places from the rows of the national point layer (columns of the shapefile, with lon and lat)."""
    if department is not None:
        raw = raw.filter(norm_name(F.col("DEP")) == _plain([department])[0])
    return raw.select(
        F.concat(F.lit("IGN-"), F.col("OBJECTID").cast("string")).alias("cp_id"), F.col("`CÓDIGO`").alias("codigo_ign"), F.col("NOM_POBLAD").alias("nombre"), F.col("DEP").alias("departamento"), F.col("PROV").alias("provincia"),
        F.col("DIST").alias("distrito"), F.col("CAT_POBLAD").alias("cat_poblad"), (norm_name(F.col("CATEGORIA")) == "CAPITAL DE DISTRITO").alias("es_capital_distrito"), "lon", "lat",
    )


def districts(raw: DataFrame, department: str | None = None) -> DataFrame:
    """Districts from the rows of the polygon layer (columns of the shapefile, with ring, the largest, and rings: all parts and holes)."""
    if department is not None:
        raw = raw.filter(norm_name(F.col("DEPARTAMEN")) == _plain([department])[0])
    return raw.select(F.col("IDDIST").cast("string").alias("ubigeo"), F.col("DEPARTAMEN").alias("departamento"), F.col("PROVINCIA").alias("provincia"), F.col("DISTRITO").alias("distrito"), "ring", "rings")


def real_dataset(facilities: DataFrame, places: DataFrame, areas: DataFrame, people: DataFrame, max_points: int = config.MAX_DEMAND_POINTS // len(config.DEPARTMENTS), seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Demand, facilities and districts: places get district codes and their part of the population; altitude is unknown; at most about max_points are kept, by district."""
    from reachway.operators.population import attach_ubigeo, distributed, stratified_sample

    demand = distributed(attach_ubigeo(places, areas), people).withColumn("altitud_m", F.lit(None).cast("double"))
    return stratified_sample(demand, max_points, "distrito", "cp_id", seed), facilities, areas


def build_real_dataset(spark: SparkSession, department: str, register: str, places: str, areas: str, people: str, out: str, max_points: int = config.MAX_DEMAND_POINTS // len(config.DEPARTMENTS), seed: int = 42, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """demand, facilities and districts of a department from the four sources' paths, as one set of Parquet tables under out (versions.py): all three count at once or none. What is there is kept: without force nothing is read or written again."""
    from reachway.sources import shapefile, versions

    names = ("demanda", "facilities", "distritos")
    found = None if force else versions.read_set(spark, out)
    if found is None or not set(names) <= set(found):
        shapefile.register(spark)
        layer = spark.read.format("shapefile")
        people_of = read_population(spark, people, [department])
        tables = real_dataset(read_facilities(spark, register, department), settlements(layer.load(places), department), districts(layer.load(areas), department), people_of, max_points, seed)
        versions.write_set(dict(zip(names, tables, strict=True)), out)
        found = versions.read_set(spark, out)
    demand, facilities, polygons = (found[n] for n in names)
    return demand, facilities, polygons


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A travel-time table (rol, source, kind, cp_id, facility_id, t_min), partitioned so that a role or source is a folder."""
    matrix.write.mode("overwrite").partitionBy("rol", "source", "kind").parquet(path)


def read_matrix(spark: SparkSession, path: str, source: str, kinds: Sequence[str] = ("drive", "drive_candidatas")) -> DataFrame:
    """All roles of one source, missing ones skipped: the filter prunes partitions. rol comes back as departamento_rol."""
    m = spark.read.option("mergeSchema", True).parquet(path).filter(F.col("source") == source).filter(F.col("kind").isin(*kinds))
    return m.select("cp_id", "facility_id", "t_min", F.col("rol").cast("string").alias("departamento_rol"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """One JSON document, or None where the file is missing."""
    reader = spark.read.option("multiLine", True)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def quality_document(reports: DataFrame) -> DataFrame:
    """All datasets' reports as one row: generado_utc and datasets, stamped with the time of the query."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    one = F.struct("dataset", now.alias("timestamp_utc"), "n_registros_inicial", "n_registros_final", "reglas")
    return reports.agg(F.array_sort(F.collect_list(one)).alias("datasets")).select(now.alias("generado_utc"), "datasets")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, nulls empty. single: one file, for results of report size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


# Characters that LaTeX reserves.
_LATEX = {"\\": r"\textbackslash ", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde ", "^": r"\textasciicircum "}


def latex_table(df: DataFrame, caption: str, label: str, float_format: str = "%.1f", max_rows: int = 1_000) -> str:
    """A table as LaTeX text, names and texts escaped, nulls as NaN. For results of report size: more than max_rows rows are an error."""
    rows = bounded(df, max_rows)
    if rows is None:
        raise ValueError(f"more than {max_rows} rows are no report table")
    clean = lambda v: "".join(_LATEX.get(c, c) for c in v)
    cell = lambda v: "NaN" if v is None else float_format % v if isinstance(v, float) else clean(str(v))
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    columns = "".join("r" if t in numeric else "l" for _, t in df.dtypes)
    head = " & ".join(map(clean, df.columns))
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\label{{tab:{label}}}\n\\begin{{tabular}}{{{columns}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def summary(metrics: DataFrame, factors: DataFrame, source: str) -> DataFrame:
    """One row: fuente, gini, counts, the factors by role as a map, and the altitude figures. factors: rol, factor_desvio."""
    from reachway.operators.access import altitude_access_cross, gini_weighted

    counts = metrics.agg(F.count("*").alias("n_demanda_total"), F.coalesce(F.sum("poblacion"), F.lit(0)).alias("poblacion_total"), F.count_if("t_min_estimado").alias("n_t_min_estimado_por_factor_desvio"))
    by_role = factors.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rol", "factor_desvio")))).alias("factor_desvio_por_departamento"))
    altitude = altitude_access_cross(metrics).select(F.struct("*").alias("cross_analysis_altitud"))
    one = gini_weighted(metrics).crossJoin(counts).crossJoin(by_role).crossJoin(altitude)  # single rows
    return one.select(F.lit(source).alias("fuente"), F.col("gini").alias("gini_t_min_ponderado"), "n_demanda_total", "poblacion_total", "n_t_min_estimado_por_factor_desvio", "factor_desvio_por_departamento", "cross_analysis_altitud")


