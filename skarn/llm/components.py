"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, component for each end of edges (a, b): the smallest node that it reaches.

    A round takes the smallest label among a node and its neighbours, then the label of that label. Rounds go on
    until none changes, about the logarithm of the longest shortest path. Each is written, so lineage stays short.
    """
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component")
        least = scratch.cut(near.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("component")), f"{name}-{step}a")
        roots = least.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = scratch.cut(least.join(roots, "component").select("node", F.col("root").alias("component")), f"{name}-{step}")
        old = labels.select("node", F.col("component").alias("was"))
        same = jumped.join(old, "node").where("component <> was").isEmpty()
        scratch.drop(f"{name}-{step}a", f"{name}-{step - 1}")
        labels = jumped
        if same:
            return labels
