"""Distributed connected components: alternating large-star and small-star rounds.

Only edge tables move; the driver learns no more than whether all components are stars yet. A node's least
neighbour is found by partial minima, and the joins that hand it on are of the kind that Spark splits where
one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import forget, written

ROUNDS = 40


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour; partial aggregates combine before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _stars(forest: DataFrame) -> bool:
    """Whether every node is either a child of one other node or a root, so that no round could change anything."""
    ends = forest.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(forest.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or c > 0 and r > 0").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (least node reachable) of every node that has an edge to another one.

    Loops and repeated edges are allowed; edges with a null end are ignored. Ends are longs.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    forest = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    forest = written(forest, "edges")
    for _ in range(ROUNDS):
        if _stars(forest):
            break
        # Large star: every larger neighbour of a node goes to the node's least neighbour (or itself).
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # Small star: a node's smaller neighbours, and itself, go to the least of them.
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, forest = forest, written(small.where("u != v").distinct(), "edges")
        forget(old)
    else:
        raise RuntimeError("connected components did not settle")
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(forest.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
