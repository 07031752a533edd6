"""Population of settlements: district totals, names to codes, shares by weight, stratified samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reachway.functions.text import half_even_count, norm_name, settlement_weight, zero_padded
from reachway.functions.workers import ready


def district_population(raw: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """Population by district over all ages and sexes, with a six-digit ubigeo; rows without a full key are left out."""
    keys = ["UBIGEO_INEI", "Departamento", "Provincia", "Distrito"]
    if departments is not None:
        raw = raw.filter(norm_name(F.col("Departamento")).isin([r for r in _plain(departments)]))
    out = raw.dropna(subset=keys).groupBy(*keys).agg(F.sum("Cantidad").alias("poblacion_distrital"))
    return out.withColumn("ubigeo", zero_padded(F.col("UBIGEO_INEI").cast("string")))


def _plain(names: list[str]) -> list[str]:
    import unicodedata

    return ["".join(c for c in unicodedata.normalize("NFKD", n.strip().upper()) if not unicodedata.combining(c)) for n in names]


def attach_ubigeo(settlements: DataFrame, districts: DataFrame) -> DataFrame:
    """settlements with ubigeo, provincia and distrito of the district of the same (normalised) names; unmatched ones keep their own names and a null code."""
    d = districts.select(norm_name(F.col("provincia")).alias("__p"), norm_name(F.col("distrito")).alias("__d"), "ubigeo", F.col("provincia").alias("__pn"), F.col("distrito").alias("__dn"))
    joined = settlements.join(d, (norm_name(F.col("provincia")) == F.col("__p")) & (norm_name(F.col("distrito")) == F.col("__d")), "left")
    return joined.withColumns({"provincia": F.coalesce("__pn", "provincia"), "distrito": F.coalesce("__dn", "distrito")}).drop("__p", "__d", "__pn", "__dn")


def shared_out(settlements: DataFrame, totals: DataFrame, weight: str) -> DataFrame:
    """settlements (with departamento, provincia, distrito) with poblacion: the district's poblacion_distrital by share of weight, half to even; 0 without a match.

    The district's weight is an aggregate that is joined back, not a window: a large district need not fit one task.
    """
    names = ("departamento", "provincia", "distrito")
    keyed = settlements.withColumns({f"__{n}": norm_name(F.col(n)) for n in names})
    keys = [f"__{n}" for n in names]
    sums = keyed.groupBy(*keys).agg(F.sum(weight).alias("__sum"))
    t = totals.select(*[norm_name(F.col(n)).alias(f"__{n}") for n in names], "poblacion_distrital")
    both = keyed.join(sums.join(t, keys, "left"), keys, "left")
    share = F.try_divide(F.col(weight).cast("double"), F.nullif(F.col("__sum").cast("double"), F.lit(0.0)))
    return both.withColumn("poblacion", half_even_count(share * F.col("poblacion_distrital"))).drop(*keys, "__sum", "poblacion_distrital")


def distributed(settlements: DataFrame, population: DataFrame, corrected: bool = False) -> DataFrame:
    """Settlements with their part of the district's population, by settlement type and rank."""
    weighed = settlements.withColumn("__peso", settlement_weight(F.col("cat_poblad"), F.col("es_capital_distrito"), corrected))
    totals = population.select(F.col("Departamento").alias("departamento"), F.col("Provincia").alias("provincia"), F.col("Distrito").alias("distrito"), "poblacion_distrital")
    return shared_out(weighed, totals, "__peso").drop("__peso")


def stratified_sample(df: DataFrame, max_points: int, strata: str = "distrito", key: str = "cp_id", seed: int = 42) -> DataFrame:
    """df whole if it has at most max_points rows; otherwise of every stratum with n rows min(n, max(1, n * max_points / all, half to even)): those of the least seeded hashes of the
    key, ties by the key, then by the other columns. Rows without a stratum are left out then.

    The k least of n hashes lie under a bound a little over k / n, but for bad luck. Only rows under it leave their tasks, equal ones as one with a count, so that
    no more than about the sample is sorted, however large a stratum is; where fewer than k lie under the bound it is raised.
    """
    total = df.count()
    if total <= max_points:
        return df
    ready(df.sparkSession)
    # the hash as a fraction of 2**53, exact in doubles
    h = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(seed)), 11).cast("double") / float(1 << 53)
    hashed = df.filter(F.col(f"`{strata}`").isNotNull()).withColumn("__h", h)
    n, k = F.col("__n"), F.col("__q")
    quota = hashed.groupBy(F.col(f"`{strata}`").alias("__s")).agg(F.count("*").alias("__n"))
    quota = quota.withColumn("__q", F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(max_points / total)).cast("bigint")))).checkpoint()
    left, parts = quota.withColumn("__bound", F.least(F.lit(1.0), (k + 6 * F.sqrt(k) + 20) / n)), []
    while True:
        under = hashed.join(left, (F.col(f"`{strata}`") == F.col("__s")) & (F.col("__h") < F.col("__bound")))
        under = under.groupBy(*[F.col(f"`{c}`") for c in df.columns], "__h", "__s", "__q").agg(F.count("*").alias("__c")).checkpoint()
        have = under.groupBy("__s").agg(F.sum("__c").alias("__have"))
        short = left.join(have, "__s", "left").filter(F.coalesce("__have", F.lit(0)) < k).drop("__have").checkpoint()
        parts.append(under.join(short.select("__s"), "__s", "left_anti"))
        if short.isEmpty():
            break
        left = short.withColumn("__bound", F.least(F.lit(1.0), F.col("__bound") * 4))
    order = W.Window.partitionBy("__s").orderBy("__h", F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in df.columns if c != key])
    found = reduce(DataFrame.unionByName, parts).withColumn("__before", F.sum("__c").over(order.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("__c"))
    copies = F.sequence(F.lit(1).cast("bigint"), F.least("__c", k - F.col("__before")))
    return found.filter(F.col("__before") < k).select(*[F.col(f"`{c}`") for c in df.columns], F.explode(copies).alias("__copy")).drop("__copy")
