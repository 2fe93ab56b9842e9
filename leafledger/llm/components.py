"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import stored


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest in its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(_smallest_neighbour(both), "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = down.join(_smallest_neighbour(down), "a")
    moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(linked.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).head()
    return row.n, row.h


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for all nodes that have an edge.

    Each round is one table in the shared folder; their number grows with the logarithm of
    the largest component. Only a count and a checksum of a round reach the driver. Rows
    with a null end and loops are no edges; an empty table gives an empty one.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    now = stored(now, "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.union(roots)
