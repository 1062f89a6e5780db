"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node of
    the component.

    Each round points every node at its smallest neighbour if that is smaller (a partial
    aggregation), follows the pointers by doubling until all end in a root, and contracts every
    tree to its root.  A chain of n nodes is one tree, whose pointers take log2(n) doublings; a
    star whose centre is not its smallest node takes two rounds.  All joins look up one row for
    each row, against a written table, so a node with very many edges can be split.  Nothing but
    emptiness reaches the driver.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        jump = near
        while True:
            far = jump.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = cut(jump.join(far, "p").select("a", "p", "q"))
            jump = step.select("a", F.col("q").alias("p"))
            if step.where("p <> q").isEmpty():
                break
        ja, jb = jump.select("a", F.col("p").alias("pa")), jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        left = cut(left.join(ja, "a").join(jb, "b").where("pa <> pb")
                   .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        labels = cut(labels.join(jump.withColumnRenamed("a", "root"), "root", "left")
                     .select("node", F.coalesce("p", "root").alias("root")))
    return labels
