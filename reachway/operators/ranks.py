"""Exact quantiles of groups of any size by rank selection: histograms that are refined around the wanted ranks, for all groups at once.

Doubles become 64-bit keys in the same order. A round counts the keys of each group by their next 16 bits, but only the keys that share all earlier bits with a wanted rank; the bin that holds the rank
is known from the running counts, and the next round looks into it alone. Four rounds fix a key; what is left of a rank after any round that is small, or a single value, is done. Counts are partly summed within
tasks, so that a task never holds a group: at most 65,536 counts for each rank that is still open.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reachway.functions.workers import ready

#: Values that are sorted to find a rank among them.
SMALL = 4_096
#: Open ranks up to this number go to all workers; more of them meet the values in a shuffle.
BROADCAST_RANKS = 200_000
_BITS = 16


def sortable(value: Column) -> Column:
    """A long for each double, in the doubles' order (both zeros are one, NaN comes last)."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _met(rows: DataFrame, open_ranks: DataFrame, on: list[str], broadcast: bool) -> DataFrame:
    """rows with the groups (and prefixes) of open_ranks, null keys being keys like others; columns of rows."""
    wanted = open_ranks.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], F.lit(True))
    return rows.join(F.broadcast(wanted) if broadcast else wanted, match, "left_semi")


def values_at(rows: DataFrame, ranks: DataFrame, keys: list[str], small: int = SMALL, broadcast_ranks: int = BROADCAST_RANKS) -> DataFrame:
    """keys, rank and value (double): the value of each wanted rank. rows: keys and v (double, not null); ranks: keys, rank (from 0, below the group's count), n (that count)."""
    keyed = rows.withColumn("bits", sortable(F.col("v")))
    state = ranks.select(*keys, "rank", F.col("rank").alias("left"), "n", F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("double").alias("value"))
    done, shift = None, 64
    while True:
        state = state.checkpoint()
        fixed = state.filter("value IS NOT NULL").select(*keys, "rank", "value")
        near = state.filter(F.col("value").isNull() & (F.col("n") <= small))
        prefix = F.shiftright("bits", shift) if shift < 64 else F.lit(0).cast("long")
        # what is small is sorted: at most `small` values a rank
        at = keyed.withColumn("prefix", prefix)
        sorted_values = _met(at, near, [*keys, "prefix"], near.count() <= broadcast_ranks).groupBy(*keys, "prefix").agg(F.array_sort(F.collect_list("v")).alias("all"))
        joined = near.alias("a").join(sorted_values.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "prefix"]]))
        found = joined.select(*[F.col(f"a.{c}").alias(c) for c in keys], "a.rank", F.element_at("b.all", (F.col("a.left") + 1).cast("int")).alias("value"))
        out = fixed.unionByName(found)
        done = out if done is None else done.unionByName(out)
        state = state.filter(F.col("value").isNull() & (F.col("n") > small))
        n = state.count()
        if not n:
            return done
        shift -= _BITS
        mine = _met(at, state, [*keys, "prefix"], n <= broadcast_ranks)
        bins = mine.groupBy(*keys, "prefix", F.shiftright("bits", shift).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        running = W.Window.partitionBy(*keys, "prefix").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("c").over(running))
        a, b = state.alias("a"), bins.alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "prefix"]])
        inside = (F.col("a.left") < F.col("b.upto")) & (F.col("a.left") >= F.col("b.upto") - F.col("b.c"))
        state = a.join(b, same & inside).select(
            *[F.col(f"a.{c}").alias(c) for c in keys], "a.rank", (F.col("a.left") - F.col("b.upto") + F.col("b.c")).alias("left"), F.col("b.c").alias("n"), F.col("b.bin").alias("prefix"),
            F.when(F.col("b.low").eqNullSafe(F.col("b.high")), F.col("b.low")).alias("value"),
        )


def group_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], groups: Sequence[str] = (), small: int = SMALL, broadcast_ranks: int = BROADCAST_RANKS) -> DataFrame:
    """groups and q (array of double, in the order of quantiles): exact quantiles of value with linear interpolation, as the built-in exact percentile gives them.

    Null values are left out; a group without any value has no row, but without groups there is always one row (q is null then, where there is no value). A null group is a group like others. NaN counts as the greatest value. Jobs run
    at the call: values are checkpointed once, and every round of refinement is one pass over them.
    """
    ready(df.sparkSession)
    keys = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").checkpoint()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 0")
    places = counts.select(*keys, "n", F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("i", "q")).withColumn("h", F.col("q") * (F.col("n") - 1))
    places = places.withColumns({"lo": F.floor("h"), "hi": F.ceil("h")}).checkpoint()
    ranks = places.select(*keys, "n", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = values_at(rows, ranks, keys, small, broadcast_ranks)
    own = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    match = reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], F.lit(True))
    low, high = F.col("o.at")[F.col("p.lo")], F.col("o.at")[F.col("p.hi")]
    part = F.when(F.col("p.lo") == F.col("p.hi"), low).otherwise((F.col("p.hi") - F.col("p.h")) * low + (F.col("p.h") - F.col("p.lo")) * high)
    each = places.alias("p").join(own.alias("o"), match).select(*[F.col(f"p.{k}").alias(k) for k in keys], "p.i", part.alias("part"))
    listed = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]).alias("q"))
    if not keys:
        return listed.select(F.when(F.size("q") > 0, F.col("q")).alias("q"))
    return listed.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], "q")


def group_medians(df: DataFrame, value: str, *groups: str, name: str = "median") -> DataFrame:
    """groups and the exact median of value; one row without groups."""
    return group_quantiles(df, value, [0.5], groups).select(*groups, F.col("q")[0].alias(name))
