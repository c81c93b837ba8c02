"""Connected components of an edge table, by joins and groupings alone.

Every edge points from the larger to the smaller node. In each round a node's edges are
hung on its smallest neighbour, and every edge jumps to its target's own smallest neighbour,
until all nodes point at a root. Edges are aggregated before they are shuffled. The smallest neighbours, one row
per node, are written apart before they are joined: where they are few they are broadcast, else Spark can split the
edges of a hub among tasks, since both sides of the join are then plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def roots(edges: DataFrame) -> DataFrame:
    """From edges (a, b), in any direction, to (node, root): the smallest node that each other node reaches.

    Roots themselves and nodes without edges are not listed. Null ends, loops and
    repeated edges are ignored.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        low = stored(edges.groupBy("a").agg(F.min("b").alias("low")))
        target = low.select(F.col("a").alias("b"), F.col("low").alias("lower"))
        hung = edges.join(low, "a")
        both = hung.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        jumped = stored(both.join(target, "b", "left").select("a", F.coalesce("lower", "b").alias("b"), (F.col("lower").isNotNull() | F.lit(False)).alias("moved")))
        edges = jumped.select("a", "b").distinct()
        # all are stars when no edge moved and no node hangs on two others
        state = jumped.agg(F.count(F.when(F.col("moved"), 1)).alias("moved"), F.count("*").alias("n")).first()
        if not state["moved"] and not edges.groupBy("a").count().where("count > 1").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = stored(edges)
