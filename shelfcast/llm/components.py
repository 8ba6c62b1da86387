"""Connected components of an edge table by alternating stars.

Each round links every node's larger neighbours to its least neighbour (large
star), then its smaller neighbours (small star), until nothing changes; the
rounds grow with the logarithm of the longest chain.  All steps are grouped
minima and joins on the node, which split under skew; every round is written,
so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root``: for each node of ``edges`` (longs a, b) that is not the
    least of its component, the least one."""
    e = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .distinct(), f"{name}-edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        e = saved(_small_star(_large_star(e)), f"{name}-star")
