"""Connected components of an edge table by alternating stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours that are larger (large) or not larger (small) than itself are linked to its smallest one instead."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")), "least")  # a plain table, so that the join can split a hub
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of longs: component is the smallest node reachable.

    Every round is written to the shared folder; rounds go on until the edges no longer change.
    A hub's edges are combined before its shuffle and its join is split by adaptive execution.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = written(_starred(_starred(now, True), False), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
