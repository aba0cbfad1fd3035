"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum per node and an equi-join, so a node with a huge degree costs no more
than its edges; nothing is gathered per node or on the driver. The number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import materialize


def _hang(pairs: DataFrame, strict: bool) -> DataFrame:
    """For each node u of ``pairs(u, v)``: hang its neighbours v on the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    hung = pairs.join(least, F.col("u") == F.col("k"))
    if strict:  # large star: only neighbours beyond u
        return hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other only, on which nothing else hangs that itself is hung on."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
    return not several.unionByName(chained).take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (longs): root is the least node that it reaches."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hang(both, strict=True).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = materialize(_hang(down, strict=False).where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
