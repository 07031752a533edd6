"""Connected components of a link table, by alternating large-star and small-star steps.

Nothing but two sums for the test of convergence reaches the driver; lineage is cut by checkpoint() after every round. A node with very many links (the centre of a star) is no key of a
shuffle join: such nodes, of which there are few by their very number of links, get their least neighbour by a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachway.llm.common import prepare


#: Links of a node from which on it counts as a centre. Twice the links over this number bounds how many centres there are.
CENTRE = 1_000_000


def _lowest(edges: DataFrame, links: int, centre: int) -> DataFrame:
    """a, b, m: the links of edges (a, b) with the least b of their a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if links <= centre:  # no node has more
        return edges.join(least.select("a", "m"), "a")
    centres = F.broadcast(least.filter(F.col("n") > centre).select("a", "m"))
    rest = edges.join(centres.select("a"), "a", "left_anti").join(least.filter(F.col("n") <= centre).select("a", "m"), "a")
    return edges.join(centres, "a").unionByName(rest)


def _sum(edges: DataFrame) -> tuple[int, object]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, rounds: int = 60, centre: int = CENTRE) -> DataFrame:
    """node, root (long) for every node of edges (a, b: long): root is the least node of its component. Null ends are ignored; repeated links, both directions and loops are fine."""
    prepare(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct().checkpoint()
    last = _sum(e)
    for _ in range(rounds if last[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both, 2 * last[0], centre).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a > b").distinct()
        met = _lowest(large, 2 * last[0], centre)
        small = met.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        e = small.distinct().checkpoint()
        now = _sum(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components did not converge in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
