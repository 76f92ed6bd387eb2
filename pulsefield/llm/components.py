"""Connected components of an edge table by alternating large and small stars.

Each step replaces a node's edges by edges to the least node it knows, so a component of any shape becomes
a star in few rounds. Between steps the edges stand in files in the shared folder,
and both sides of a join are read from files, so adaptive execution can split the rows of a
hub that is linked to much of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, release


def _least(edges: DataFrame) -> DataFrame:
    """u and the least node among u and its neighbours, from symmetric edges (u, v)."""
    return materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component, the least node reachable, for each node of edges (u, v); loops are ignored.

    An empty edge table yields no rows.
    """
    current = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while True:  # rounds grow with the logarithm of the longest path
        # Large star: every node hands its least known node to its larger neighbours.
        both = materialize(_both(current), "both")
        least = _least(both)
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        release(both, least)
        # Small star: every node hands its least smaller neighbour to the others and itself.
        least = _least(large)
        spread = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = materialize(spread.select("e.*").where("u <> v").distinct(), "small")
        same = small.count() == current.count() and small.exceptAll(current).isEmpty()
        release(current, large, least)
        current = small
        if same:
            heads = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads)
