"""Connected components of an edge table, without collecting it anywhere.

Alternating large-star and small-star contractions: every round is two
groupBy-min passes and two equi-joins over the edges, so a component of any
size is never held by one task, and the number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return int(row.n), int(row.h)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Links the neighbours of each node to their smallest member."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    # Checkpointed apart: both sides of the join are then plain exchanges, which
    # adaptive execution splits when a node has very many neighbours.
    low = cut(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = near.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return cut(out.filter("u > v").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long), any order, repeats allowed -> (node, root): root = smallest node.

    Nodes are those that occur in an edge between two different nodes; roots are
    listed too. An empty edge table gives an empty result.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    seen = _fingerprint(edges)
    while seen[0]:
        edges = _star(_star(edges, True), False)
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
