"""Connected components of a graph too large for one machine: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialized


def _star(directed: DataFrame) -> DataFrame:
    """u, v, m: each directed edge with the smallest node among u and the nodes it points to."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> node, component: the smallest node it is connected with, for all nodes in an edge.

    Nothing is gathered: a round is an aggregate and a join, written to the shared folder. A node with very
    many edges is a skewed join key, which adaptive execution splits. Loops and repeated edges do no harm.
    """
    edges = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u != v").distinct()
    edges = materialized(edges, "components")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        stars = _star(large)
        small = stars.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialized(small.select("e.*").filter("u != v").distinct(), "components")
        # Done when each node points to one other and no node that is pointed to points on.
        marks = after.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            after.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        open_nodes = marks.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if open_nodes.filter("out > 1 or (out > 0 and into > 0)").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        edges = after
