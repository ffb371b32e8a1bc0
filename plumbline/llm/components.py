"""Connected components by alternating large-star and small-star rounds; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.llm.common import written


def _nearest(edges: DataFrame, way: str) -> DataFrame:
    """One star round over (u, v) with u > v: every neighbour of a node is linked to its smallest neighbour."""
    both = edges if way == "small" else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that both sides of the join are plain exchanges: Spark can split a node of very many links.
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    met = both.join(least, "u")
    if way == "small":
        moved = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
    else:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (u, v) of longs: the smallest node that it is linked to by any path.

    Links may be repeated, in either direction, or from a node to itself; nodes without other links are left out.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        seen = Observation()
        watched = now.observe(seen, F.count("*").alias("links"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        now, state = written(watched, "links"), seen.get
        if state == before or not state.get("links"):
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state
        now = _nearest(_nearest(now, "large"), "small")
