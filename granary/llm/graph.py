"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import saved


def _summary(edges: DataFrame) -> tuple:
    """Count and an order-free digest of a table of pairs."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node reachable.

    ``edges`` has columns a and b of one orderable type; loops and repeats do no harm, nulls are left out, no
    edges give no rows. Every round replaces neighbours by the smallest one, so a star is done in two rounds and a
    chain in a logarithmic number. Minima are combined before the shuffle, each round is written to the shared
    folder.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "edges")
    before = _summary(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("low").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b")
        now = saved(small.distinct(), "edges")
        after = _summary(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
