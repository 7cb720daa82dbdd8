"""Connected components of an edge table, by alternating large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtally.llm.work import removed, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every vertex on its smallest neighbour."""
    around = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = around.join(lowest, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lowest.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex with an edge (a, b); a component is named by its smallest vertex. Edges without an end are none.

    Each round reads and writes a table of at most as many edges as vertices and given edges; the number of rounds
    grows with the logarithm of the longest path.
    """
    now = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while True:
        after = written(_star(_star(now, True), False), "edges")
        done = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        removed(now)
        now = after
        if done:
            break
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).union(roots)
