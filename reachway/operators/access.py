"""Population-weighted access measures. Missing times are NULL; weights are populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reachway import config
from reachway.functions.workers import ready
from reachway.operators.ranks import group_medians, group_quantiles


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def _time_mean(time: str, weight: str) -> Column:
    """Sum of time by weight over weight, of rows with a time; null if they weigh nothing."""
    valid = F.col(time).isNotNull()
    w = F.sum(F.when(valid, F.col(weight)))
    return F.when(w > 0, F.sum(F.when(valid, F.col(time) * F.col(weight))) / w)


def _estimated(weight: str, estimated: str) -> Column:
    return F.coalesce(F.sum(F.when(F.coalesce(F.col(estimated), F.lit(False)), F.col(weight))), F.lit(0))


def band(time: Column, thresholds: Sequence[int] = config.THRESHOLDS_MIN) -> Column:
    """The ordinal of a time's band (0 for [0, first], then half-open bands, one past the thresholds for more, two past for no time); null for a negative time."""
    out = F.when(time.isNull(), len(thresholds) + 1).when(time < 0, F.lit(None).cast("int"))
    for i, t in enumerate(sorted(thresholds)):
        out = out.when(time <= t, i)
    return out.otherwise(len(thresholds))


def coverage_bands(df: DataFrame, time: str = "t_min", weight: str = "poblacion", estimated: str | None = "t_min_estimado", thresholds: Sequence[int] = config.THRESHOLDS_MIN) -> DataFrame:
    """Population by band of access time, with its share of the banded total and the share of each band that rests on estimates; by band."""
    ordered = sorted(thresholds)
    labels = [*(f"<= {t} min" for t in ordered), f"> {ordered[-1]} min", config.NO_ROUTE]
    grouped = df.withColumn("orden", band(F.col(time), ordered)).filter("orden IS NOT NULL").groupBy("orden")
    sums = [F.sum(weight).alias("poblacion")] + ([_pct(_estimated(weight, estimated), F.sum(weight)).alias("pct_estimado_por_desvio")] if estimated else [])
    out = grouped.agg(*sums)
    total = F.sum("poblacion").over(W.Window.partitionBy())  # over at most five rows
    out = out.withColumn("pct_poblacion", F.try_divide(F.col("poblacion") * F.lit(100.0), total))
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("orden") + 1)
    return out.select(label.alias("banda"), "poblacion", "pct_poblacion", *(["pct_estimado_por_desvio"] if estimated else []), "orden").orderBy("orden").drop("orden")


def weighted_mean_access(df: DataFrame, group: str, time: str = "t_min", weight: str = "poblacion", estimated: str | None = "t_min_estimado") -> DataFrame:
    """Mean time by population and share of estimates, by group; slowest first. Rows without a group are left out; so are rows without a time, from the mean only."""
    share = _pct(_estimated(weight, estimated), F.sum(weight)) if estimated else F.lit(None).cast("double")
    out = df.filter(F.col(group).isNotNull()).groupBy(group).agg(_time_mean(time, weight).alias("t_min_ponderado"), share.alias("pct_estimado"))
    return out.orderBy(F.desc_nulls_last("t_min_ponderado"), group)


def critical_districts(df: DataFrame, group: str = "distrito", top: int = 10, **columns) -> DataFrame:
    """The slowest groups."""
    return weighted_mean_access(df, group, **columns).limit(top)


def urban(population: Column) -> Column:
    return F.coalesce(population >= config.URBAN_POPULATION, F.lit(False))


def urban_rural_contrast(df: DataFrame, **columns) -> DataFrame:
    return weighted_mean_access(df.withColumn("es_urbano", urban(F.col(columns.get("weight", "poblacion")))), "es_urbano", **columns)


#: Buckets of the running sums below.
_BUCKETS = 256


def gini_weighted(df: DataFrame, time: str = "t_min", weight: str = "poblacion") -> DataFrame:
    """gini (double): of times by population, from the Lorenz curve; null without rows, weight or time.

    Running sums go over distinct values, in two levels: sums by bucket of values, then within buckets. So no task sorts all values. Sums by value are checkpointed: four steps read them. The area
    below the curve doesn't depend on the order of ties.
    """
    ready(df.sparkSession)
    valid = df.filter(F.col(time).isNotNull() & F.col(weight).isNotNull())
    by_value = valid.groupBy(F.col(time).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w")).checkpoint()
    cuts = by_value.agg(F.percentile_approx("v", [i / _BUCKETS for i in range(1, _BUCKETS)], 10_000).alias("cuts"))  # one row
    bucket = F.coalesce(F.array_size(F.filter(F.array_distinct("cuts"), lambda e: e < F.col("v"))), F.lit(0))
    rows = by_value.crossJoin(F.broadcast(cuts)).select("v", "w", bucket.alias("b"), (F.col("v") * F.col("w")).alias("vw"))
    before = W.Window.orderBy("b").rowsBetween(W.Window.unboundedPreceding, -1)  # over at most _BUCKETS rows
    offsets = rows.groupBy("b").agg(F.sum("vw").alias("part")).select("b", F.coalesce(F.sum("part").over(before), F.lit(0.0)).alias("offset"))
    within = W.Window.partitionBy("b").orderBy("v").rowsBetween(W.Window.unboundedPreceding, 0)
    summed = rows.join(F.broadcast(offsets), "b").withColumn("cx", F.col("offset") + F.sum("vw").over(within))
    terms = summed.agg(F.sum((2 * F.col("cx") - F.col("vw")) * F.col("w")).alias("s"), F.sum("vw").alias("x"), F.sum("w").alias("w"))
    return terms.select((1 - F.try_divide("s", F.col("x") * F.col("w"))).alias("gini"))


def altitude_access_cross(df: DataFrame, altitude: str = "altitud_m", time: str = "t_min", weight: str = "poblacion") -> DataFrame:
    """r_ponderado, pendiente_min_por_metro, n, interpretacion: weighted correlation and slope over complete rows, from centred moments; null
    where there are fewer than two rows or no variance."""
    rows = df.select(F.col(altitude).cast("double").alias("x"), F.col(time).cast("double").alias("y"), F.col(weight).cast("double").alias("w")).dropna()
    means = rows.agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("mx"), F.try_divide(F.sum(F.col("y") * F.col("w")), F.sum("w")).alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    m = rows.crossJoin(F.broadcast(means)).agg(F.count("*").alias("n"), F.sum("w").alias("w"), *[F.sum(v * F.col("w")).alias(k) for k, v in (("xy", dx * dy), ("xx", dx * dx), ("yy", dy * dy))])
    enough = F.col("n") >= 2
    r = F.when(enough & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    slope = F.when(enough & (F.col("xx") > 0), F.col("xy") / F.col("xx"))
    text = F.when(enough, F.lit("Correlational, not causal: altitude goes with rurality and road density, which are not separated here.")).otherwise(F.lit("Too few rows with an altitude."))
    return m.select(r.alias("r_ponderado"), slope.alias("pendiente_min_por_metro"), "n", text.alias("interpretacion"))


def two_step_floating_catchment(matrix: DataFrame, demand: DataFrame, facilities: DataFrame, threshold: float = config.SFCA_THRESHOLD_MIN, population: str = "poblacion", capacity: str = "capacidad") -> DataFrame:
    """cp_id, accesibilidad_2sfca for every demand row: the sum over reachable facilities of capacity by population within the threshold; 0 without any.

    Pairs beyond the threshold go before any shuffle. A facility whose catchment has no population counts for nothing.
    """
    near = matrix.filter(F.col("t_min") <= threshold).select("cp_id", "facility_id")
    near = near.join(demand.select("cp_id", population), "cp_id", "left").join(facilities.select("facility_id", capacity), "facility_id", "left")
    step1 = near.groupBy("facility_id").agg(F.sum(population).alias("p"), F.max(capacity).alias("c"))
    ratio = step1.select("facility_id", F.when(F.col("p") > 0, F.col("c") / F.col("p")).alias("r"))
    step2 = near.select("cp_id", "facility_id").join(ratio, "facility_id", "left").groupBy("cp_id").agg(F.sum("r").alias("a"))
    return demand.select("cp_id").join(step2, "cp_id", "left").select("cp_id", F.coalesce("a", F.lit(0.0)).alias("accesibilidad_2sfca"))


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal-width bins over the range of values, by segment: bin (0-based; the last one is closed), lower edge, n."""
    span = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.max(F.col("lo") + at * width).alias("desde"))


def thirds(df: DataFrame, value: str, labels: Sequence[str], name: str) -> DataFrame:
    """df with name: the label of value's equal-width bin over the range, bins closed on the right and the first on both sides."""
    span = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / len(labels)
    at = F.greatest(F.lit(1), F.least(F.lit(len(labels)), F.coalesce(F.ceil(F.try_divide(F.col(value) - F.col("__lo"), width)), F.lit(1)))).cast("int")
    return df.crossJoin(F.broadcast(span)).withColumn(name, F.when(F.col(value).isNotNull(), F.element_at(F.array(*map(F.lit, labels)), at))).drop("__lo", "__hi")


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *columns).unpivot(list(keys), list(columns), "perfil", "valor").filter("valor IS NOT NULL")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """perfil, mean, mediana (exact), max of each column, nulls left out."""
    long = _long(df, columns)
    return long.groupBy("perfil").agg(F.avg("valor").alias("mean"), F.max("valor").alias("max")).join(group_medians(long, "valor", "perfil", name="mediana"), "perfil").select("perfil", "mean", "mediana", "max")


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """perfil, q1, mediana, q3 (exact) of each column."""
    q = group_quantiles(_long(df, columns), "valor", [0.25, 0.5, 0.75], ["perfil"])
    return q.select("perfil", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "mediana", "q3"))])


def medians_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """The exact median of each of these columns by group, null groups left out; null where a group has no value."""
    rows = df.filter(F.col(group).isNotNull())
    medians = group_medians(_long(rows, columns, [group]), "valor", group, "perfil", name="m")
    wide = medians.groupBy(group).pivot("perfil", list(columns)).agg(F.first("m"))
    return rows.select(group).distinct().join(wide, group, "left")
