"""Property graphs as two DataFrames: nodes (id, label, ...) and edges (src, dst, type)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialised


def match_hop(nodes: DataFrame, edges: DataFrame, label_a: str | None = None, kind: str | None = None, label_b: str | None = None) -> DataFrame:
    """(a, type, b) of directed edges of a kind between labelled nodes."""
    e = edges.filter(F.col("type") == kind) if kind else edges
    ends = {}
    for side, label in (("a", label_a), ("b", label_b)):
        own = nodes.filter(F.col("label") == label) if label else nodes
        ends[side] = own.select(F.col("id").alias(side))
    return e.select(F.col("src").alias("a"), "type", F.col("dst").alias("b")).join(ends["a"], "a").join(ends["b"], "b").select("a", "type", "b")


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst").distinct()


def _levels(edges: DataFrame, source: int):
    """(id, parent) of each step of a breadth-first search, materialised; a node's parent is its smallest of the step before.

    Links go both ways, so what a step finds is new unless it is in one of the last two steps: no step reads more
    than these, whatever was reached before.
    """
    links = materialised(undirected(edges))
    level = materialised(edges.sparkSession.createDataFrame([(source, None)], "id long, parent long"))
    before = level.limit(0)
    while not level.isEmpty():
        yield level
        found = links.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").cast("long").alias("id")).agg(F.min("src").cast("long").alias("parent"))
        known = level.select("id").unionByName(before.select("id"))
        before, level = level, materialised(found.join(known, "id", "left_anti"))


def neighbors(edges: DataFrame, source: int, depth: int) -> DataFrame:
    """(id, depth) of nodes within depth undirected steps of the source, without it; depth is the fewest steps."""
    reached = edges.sparkSession.createDataFrame([], "id long, depth int")
    for step, level in enumerate(itertools.islice(_levels(edges, source), depth + 1)):
        if step:
            reached = reached.unionByName(level.select("id", F.lit(step).alias("depth")))
    return reached


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """(source, target, length, path): a path of the fewest undirected steps as an array of ids; null if there is none.

    Of several the one whose ids are smallest from the target back.  A path of one node leads from a node to itself.
    """
    passed, at = [], None
    for level in _levels(edges, source):
        passed.append(level)
        at = level.filter(F.col("id") == target).first()
        if at is not None:
            break
    path = [target]
    for level in reversed(passed[:-1] if at is not None else []):
        path.append(at["parent"])
        at = level.filter(F.col("id") == path[-1]).first()
    found = (source, target, len(path) - 1, path[::-1]) if at is not None else (source, target, None, None)
    return edges.sparkSession.createDataFrame([found], "source long, target long, length int, path array<long>")


def create_nodes(rows: DataFrame, label: str, id_col: str, *properties: str) -> DataFrame:
    """(id, label, props) with the named columns as a map of properties; null ones are left out."""
    cells = F.map_from_arrays(F.array(*(F.lit(p) for p in properties)), F.array(*(F.col(p).cast("string") for p in properties)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.lit(label).alias("label"), F.map_filter(cells, lambda _, v: v.isNotNull()).alias("props"))


def create_edges(rows: DataFrame, nodes: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    """(src, dst, type) of the rows whose two ends are nodes."""
    edges = rows.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.lit(kind).alias("type"))
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")
