"""The whole access study as one plan: department and profile are columns, not loops.

Inputs are tables with a role column (rol): demand, facilities, and for each profile nodes and edges. A role without any active surgical facility keeps its demand
with null times, instead of vanishing from the totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachway import config
from reachway.functions.workers import ready
from reachway.operators import access, graph, modes, quality
from reachway.operators.scenario import columns_with
from reachway.sources import files, synthetic

#: Text columns that the encoding rule repairs.
DEMAND_TEXT = ("nombre", "departamento", "distrito", "provincia")
FACILITY_TEXT = ("nombre", "categoria", "institucion", "departamento")


@dataclass
class Study:
    """Results of a run, lazily; tables carry rol."""

    demand_metrics: DataFrame
    facilities: DataFrame
    matrix: DataFrame
    mode_comparison: DataFrame
    straight_vs_network: DataFrame
    factors: DataFrame
    isochrones: DataFrame
    sfca: DataFrame
    quality: DataFrame
    snap: DataFrame
    source: str = "synthetic"
    districts: DataFrame | None = None

    def outputs(self) -> dict[str, DataFrame]:
        """The tables that a run writes."""
        m = self.demand_metrics
        out = {
            "demanda_metrics": m, "facilities_validated": self.facilities, "coverage_bands": access.coverage_bands(m), "critical_districts": access.critical_districts(m), "urban_rural_contrast": access.urban_rural_contrast(m),
            "mode_comparison": self.mode_comparison, "mode_ratio_summary": access.describe(self.mode_comparison, columns_with(self.mode_comparison, "ratio_")),
            "straight_line_vs_network": self.straight_vs_network, "straight_line_vs_network_summary": modes.straight_vs_network_summary(self.straight_vs_network, "rol"), "sfca_2step": self.sfca, "isochrones": self.isochrones,
            "distribucion_t_min": access.histogram(m, "t_min", 30, ["departamento"]), "snap_report": self.snap, "quality_report": files.quality_document(self.quality), "summary": files.summary(m, self.factors, self.source),
        }
        out |= {f"access_by_{g}": access.weighted_mean_access(m, g) for g in ("distrito", "provincia", "departamento")}
        if self.districts is not None and "ubigeo" in m.columns:
            from reachway.operators.scenario import choropleth

            out["distritos_choropleth"] = choropleth(self.districts, m)
        return out


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def study(demand: Mapping[str, DataFrame], facilities: Mapping[str, DataFrame], graphs: Mapping[tuple[str, str], tuple[DataFrame, DataFrame]], districts: Mapping[str, DataFrame] | None = None, source: str = "synthetic", routable_only: bool = False) -> Study:
    """A study over roles. graphs: nodes and edges by (role, profile). districts: polygons (ubigeo, ring) by role, for the polygon rule. routable_only: points snap to nodes with
    an edge only (recommended; the default counts all nodes)."""
    parts: dict[str, list[DataFrame]] = {k: [] for k in ("metrics", "facilities", "matrix", "modes", "svn", "factors", "iso", "sfca", "quality", "snap")}
    for role, d in demand.items():
        polygons, f, tag = (districts or {}).get(role), facilities[role], F.lit(role).alias("rol")
        key = "ubigeo" if polygons is not None else None
        parts["quality"] += [quality.quality_report(d, f"{role}_demanda", "cp_id", DEMAND_TEXT, key=key, polygons=polygons), quality.quality_report(f, f"{role}_facilities", "facility_id", FACILITY_TEXT)]
        d = quality.validated(d, "cp_id", DEMAND_TEXT, key=key, polygons=polygons).drop("rol").checkpoint()
        f = quality.with_category(quality.validated(f, "facility_id", FACILITY_TEXT)).drop("rol").checkpoint()
        able, others = f.filter("resolutivo AND activo"), f.filter("NOT resolutivo AND activo")
        parts["facilities"].append(f.select("*", tag))
        matrices = []
        for profile in config.PROFILES:
            nodes, edges = graphs[role, profile]
            live = edges if routable_only else None
            layers = [("demanda", d, "cp_id", "drive"), ("facilities", able, "facility_id", profile)] + ([("facilities_candidatas", others, "facility_id", "drive_candidatas")] if profile == "drive" else [])
            snapped = {}
            for layer, points, id_col, _ in layers:
                # ids are text here: snapping goes by their hashes
                numbered = points.select(F.xxhash64(F.col(id_col).cast("string")).alias("id"), id_col, "lon", "lat").filter(F.col(id_col).isNotNull())
                s = modes.snap(numbered, nodes, live).join(numbered.select("id", id_col), "id").select(id_col, "node_id", "snap_dist_m").checkpoint()
                snapped[layer] = s
                parts["snap"].append(modes.snap_report(s).select(tag, F.lit(profile).alias("profile"), F.lit(layer).alias("capa"), F.lit(source).alias("graph_source"), "*"))
            for layer, _, _, kind in layers[1:]:
                m = graph.travel_time_matrix(edges, snapped["demanda"], snapped[layer]).checkpoint()
                parts["matrix"].append(m.select(tag, F.lit(source).alias("source"), F.lit(kind).alias("kind"), "*"))
                if layer == "facilities":
                    matrices.append(m.select(F.lit(profile).alias("profile"), "*"))
            if profile == "drive":
                parts["iso"].append(graph.isochrones(edges, nodes, snapped["facilities"]).select(tag, "*"))
        every = _union(matrices)
        drive = every.filter("profile = 'drive'").drop("profile")
        metrics = _metrics(drive, d, able)
        parts["metrics"].append(metrics[0].select("*", tag))
        parts["svn"].append(metrics[1].select("*", tag))
        parts["factors"].append(metrics[2].select(tag, "factor_desvio"))
        parts["modes"].append(modes.compare_modes(every).select("*", tag))
        parts["sfca"].append(access.two_step_floating_catchment(drive, d, able).select("*", tag))
    u = {k: _union(v) for k, v in parts.items()}
    return Study(u["metrics"], u["facilities"], u["matrix"], u["modes"], u["svn"], u["factors"], u["iso"], u["sfca"], u["quality"], u["snap"], source, None if districts is None else _union(list(districts.values())))


def _metrics(drive: DataFrame, demand: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Demand metrics, straight line against network, and the detour factor of one role whose ids are text: nearest points are found by hashed ids."""
    d = demand.withColumn("__cp", F.col("cp_id")).withColumn("cp_id", F.xxhash64("__cp"))
    f = facilities.withColumn("__f", F.col("facility_id")).withColumn("facility_id", F.xxhash64("__f"))
    m = drive.withColumns({"cp_id": F.xxhash64("cp_id"), "facility_id": F.xxhash64("facility_id")})
    names, points = f.select(F.col("facility_id").alias("n"), F.col("__f")), d.select(F.col("cp_id").alias("c"), F.col("__cp"))

    def named(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(names, F.col(c) == F.col("n"), "left").drop(c, "n").withColumnRenamed("__f", c)
        return df

    svn = modes.straight_vs_network(m, d, f).checkpoint()
    factor = modes.circuity_factor(svn)
    metrics = named(modes.demand_metrics(m, d, f).drop("cp_id").withColumnRenamed("__cp", "cp_id"), "facility_mas_cercana")
    svn = named(svn, "facility_recta", "facility_red").join(points, F.col("cp_id") == F.col("c")).drop("cp_id", "c").withColumnRenamed("__cp", "cp_id")
    return metrics, svn, factor


def synthetic_study(spark: SparkSession, roles: Sequence[str] = tuple(config.DEPARTMENTS), n_demand: int = 200, n_facilities: int = 20, n_nodes: int = 250, seed: int = 42) -> Study:
    ready(spark)
    graphs = {}
    for r in roles:
        for p in config.PROFILES:
            nodes, edges = synthetic.road_graph(spark, r, p, n_nodes, seed=seed)
            graphs[r, p] = nodes.checkpoint(), edges.checkpoint()
    return study({r: synthetic.demand(spark, r, n_demand, seed) for r in roles}, {r: synthetic.facilities(spark, r, n_facilities, seed) for r in roles}, graphs)


def export(result: Study, folder: str) -> None:
    """Every output as Parquet; the small ones as CSV, JSON and LaTeX text too."""
    result.demand_metrics = result.demand_metrics.checkpoint()
    files.write_matrix(result.matrix, f"{folder}/matrix")
    for name, df in result.outputs().items():
        df.write.mode("overwrite").parquet(f"{folder}/parquet/{name}")
        small = result.matrix.sparkSession.read.parquet(f"{folder}/parquet/{name}")
        if name in ("quality_report", "snap_report", "summary"):
            files.write_json(small, f"{folder}/json/{name}")
        elif name.startswith(("access_by", "coverage", "critical", "urban", "straight_line_vs_network_summary")):
            files.write_csv(small, f"{folder}/csv/{name}", single=True)
        if name in ("coverage_bands", "critical_districts", "mode_ratio_summary", "straight_line_vs_network_summary"):
            result.matrix.sparkSession.createDataFrame([(files.latex_table(small, name, name),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/tables/{name}")
