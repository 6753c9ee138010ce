"""Connected components by alternating large-star and small-star.

Large-star links each node's larger neighbours to the least node it knows, small-star its smaller
ones and itself; repeated, every component becomes a star around its least node. A hub's neighbours
are never gathered: minima are pre-aggregated, then joined back, where adaptive execution may split
a hub's rows. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) for every node of ``edges(u, v)`` but the
    least ones of their components. Edges from a node to itself and repeated ones don't matter."""
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
    now = scratch.save(edges.where("u <> v").select("u", "v").distinct())
    was = None
    while (at := state(now)) != was:
        was = at
        new = scratch.save(_small_star(_large_star(now)).distinct())
        scratch.drop(now)
        now = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._scratch_path = now._scratch_path
    return out
