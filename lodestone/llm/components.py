"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = _both_ways(edges)
    least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")))
    return join_counted(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of them; edges run from larger to smaller."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = join_counted(edges, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the least node reachable.

    Loops and repeated edges are allowed; nodes without an edge to another node
    are absent. No edges: no rows. Each round is stored, a node with very many
    edges is spread over tasks, and rounds grow with the logarithm of the number of nodes; what a round
    shuffles is no more than the edges, and only the count and a checksum of
    the edges come to the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        now = cut(_small_star(cut(_large_star(now, state[0])), state[0]))
    # Stars remain: every edge runs from a node to the least of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
