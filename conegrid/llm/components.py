"""Connected components of an edge table by minimum-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Each round takes the least label around a node, then the label of that label, so a chain of n
    nodes needs about log n rounds; a round's table is written to the shared folder, so that neither
    lineage nor recovery grows with the rounds. Nulls and self-loops are left out; repeated edges
    are harmless; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialize(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        step = nearer.join(jump, nearer["near"] == jump["to"], "left").select("node", F.col("label").alias("was"), F.least("near", "beyond").alias("label"))
        step = materialize(step)
        if step.where("was <> label").isEmpty():
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
