"""Connected components of a graph given as an edge table, wholly distributed.

Rounds of large-star and small-star: each moves every node's links to the smallest node it knows of,
until each component is a star around its smallest node.  A round costs joins on the edges alone; the
edges of each round are cut off from their lineage in the shared folder, so a lost executor costs one
round at most.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge table (a, b); component is its smallest reachable node.

    Edges with a null end and loops are left out; repeated edges count once; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    stars = cut(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = _state(stars)
    for _ in range(max_rounds if seen[0] else 0):
        stars = cut(_small_star(_large_star(stars)))
        now = _state(stars)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = stars.select(a.alias("node"), b.alias("component"))
    return found.unionByName(stars.select(b.alias("node"), b.alias("component")).distinct())


def _state(stars: DataFrame) -> tuple:
    r = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest neighbour (or the node, if that is smaller)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Edges are (larger, smaller): the larger neighbours of b are the a of its edges.
    moved = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
    return moved.filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
