"""Distributed union-find: components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.shared import write_shared

#: Rounds after which something must be wrong; a path of n nodes takes about log n.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` as ``id, component``: each node with an edge, and the smallest node it reaches.

    Each round points the larger neighbours of a node, then the smaller ones, to its smallest neighbour. Both are a
    minimum by node (with a partial step before the shuffle) joined back to the edges. The join has one row a node on one
    side, so that adaptive execution can split a node with very many edges on the other. Rounds are cut by written tables; the loop ends when every edge leads from a node of
    one edge to a node that is nobody's child. Loops and null ends are dropped.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = write_shared(pairs, "edges")
    for _ in range(MOST_ROUNDS):
        ends = now.select(F.explode(F.array(_end("a", 1, 0), _end("b", 0, 1))).alias("e")).select("e.*")
        unsettled = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if unsettled.filter("child > 1 or (child = 1 and parent = 1)").isEmpty():
            parents = now.select(F.col("b").alias("id")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                parents.select("id", F.col("id").alias("component"))
            )
        now = write_shared(_small_star(_large_star(now)), "edges")
    raise RuntimeError("the components did not settle")


def _end(column: str, child: int, parent: int) -> Column:
    return F.struct(F.col(column).alias("node"), F.lit(child).alias("child"), F.lit(parent).alias("parent"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select("b", "least").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
