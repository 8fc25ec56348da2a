"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so a hub's edges are
pre-aggregated for the minimum and split by the skew join; no group is ever
collected.  Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import store


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (u, v; any sortable type, no nulls) to (node, component): the
    least node of the component, for every node that has an edge to another
    one.  Repeated edges, loops and both directions are fine; no edges give no rows."""
    edges = store(edges.select("u", "v").where("u <> v").distinct(), name)
    state = _state(edges)
    while state[0]:
        edges = store(_small_star(_large_star(edges)), name)
        now = _state(edges)
        if now == state:
            break
        state = now
    # stars: every node but the centre points at the centre
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
