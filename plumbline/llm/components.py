"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Labels spread along edges and then to the label's own label, which halves the way left each round;
    every round is a few joins, and ends in a checkpoint. Edges may repeat and run either way.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = checkpointed(both.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("far"))
        moved = checkpointed(moved.join(jump, "step", "left").select("node", "old", F.coalesce("far", "step").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
