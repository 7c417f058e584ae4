"""Connected components of a link table by alternating large-star and small-star rounds, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_table


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, undirected). Returns node, component (the smallest node reachable) for every node with a link.

    Nulls and self-links are left out; repeated links count once; no links give an empty table. Each round groups by
    node for the minimum (combined before the shuffle) and joins it back, so no group is gathered in one place.
    """
    e = materialise(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(e)
    while before[0]:  # until a round changes nothing; their number grows with the square of the logarithm of the longest path at most
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = materialise(small.where("a != b").distinct())
        after = _mark(new)
        remove_table(e)
        e = new
        if after == before:
            break
        before = after
    roots = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
