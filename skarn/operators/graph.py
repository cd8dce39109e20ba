"""Hierarchies as edge tables: closure, ancestors, cycles, and repair of parents.

Levels are followed to their end. A caller may set a bound; a hierarchy that goes deeper is then an error, never cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources.shared import written


def _bounded(depth: int, max_depth: int | None) -> None:
    if max_depth is not None and depth > max_depth:
        raise ValueError(f"the hierarchy is deeper than {max_depth}")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """ancestor, descendant, depth, path of edges (parent, child), depth 1 and more.

    Each level is one join with the edges; a path never meets a node twice, so cycles end by themselves.
    """
    step = edges.select(F.col("parent").alias("p"), F.col("child").alias("c"))
    level = written(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"), F.array("parent", "child").alias("path")), "closure")
    levels, depth = [], 1
    while not levels or not level.isEmpty():
        _bounded(depth, max_depth)
        levels.append(level)
        depth += 1
        grown = level.join(step, level["descendant"] == step["p"]).where(~F.array_contains("path", F.col("c")))
        level = written(grown.select("ancestor", F.col("c").alias("descendant"), F.lit(depth).alias("depth"), F.concat("path", F.array("c")).alias("path")), "closure")
    return reduce(DataFrame.unionByName, levels)


def ancestors(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, ancestor, distance for the given nodes: only their own chains are followed upwards."""
    up = edges.select(F.col("child").alias("c"), F.col("parent").alias("p"))
    level = nodes.select("node", F.col("node").alias("at"), F.array("node").alias("path"))
    found, distance = [], 0
    while True:
        distance += 1
        level = written(level.join(up, level["at"] == up["c"]).where(~F.array_contains("path", F.col("p"))).select("node", F.col("p").alias("at"), F.concat("path", F.array("p")).alias("path")), "ancestors")
        if distance > 1 and level.isEmpty():
            break
        _bounded(distance, max_depth)
        found.append(level.select("node", F.col("at").alias("ancestor"), F.lit(distance).alias("distance")))
    return reduce(DataFrame.unionByName, found)


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves.

    Nodes without parents, and nodes without children, lie on no cycle; they are taken away until none is left. What
    remains, the cycles and the ways between them, is followed, by ways of twice the length each round, until no new pair is reached.
    """
    core = written(edges.select("parent", "child").where("parent <> child").distinct(), "core")
    while True:
        inner = core.join(core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        less = written(inner.select("parent", "child"), "core")
        if less.count() == core.count():
            break
        core = less
    reach = core.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    while True:  # each round doubles the length of the ways that are known
        on = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = written(reach.join(on, "b").select("a", F.col("c").alias("b")).distinct().join(reach, ["a", "b"], "left_anti"), "reach")
        if new.isEmpty():
            break
        reach = written(reach.unionByName(new), "reach")
    itself = edges.where("parent = child").select(F.col("parent").alias("node"))
    return reach.where("a = b").select(F.col("a").alias("node")).union(itself).distinct()


def parent_repair(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each edge of either side with what is to be done: keep, add or delete."""
    a, b = existing.select("parent", "child").distinct().withColumn("old", F.lit(True)), wanted.select("parent", "child").distinct().withColumn("new", F.lit(True))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").otherwise("keep")
    return a.join(b, ["parent", "child"], "full").select("parent", "child", action.alias("action"))


def hierarchy_problems(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_parents of nodes (node, is_root) with a wrong number of parents: roots have none, others one."""
    counted = nodes.join(edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node", "left").select("node", "is_root", F.coalesce("n", F.lit(0).cast("long")).alias("n_parents"))
    return counted.where(F.col("n_parents") != F.when(F.col("is_root"), 0).otherwise(1)).select("node", "n_parents")


def dot(edges: DataFrame, group: str) -> DataFrame:
    """A DOT graph of each group's edges, lines in order."""
    line = F.format_string('"%s" -> "%s";', "parent", "child")
    return edges.groupBy(group).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n"), F.lit("\n}")).alias("dot"))
