"""Connected components of an edge table, by alternating large and small stars.

Each round is joins and sums over the edges; a hub's edges are split by Spark's skewed joins, and no component is ever
gathered in one task. Rounds are written to the shared folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, label) of the nodes of edges (columns a and b, long, not null); label is the least node of the component.
    Loops and repeated edges do not matter; an empty table gives an empty one."""
    edges = common.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: every node and its least lower neighbour, and its other lower neighbours with that
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = common.saved(small.where("a <> b").distinct(), "edges")
        # done when all are stars: no node has two lower neighbours, and no centre has one
        roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        if roles.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR (low > 0 AND high > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
