"""Hits as an ordered list of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import collapse
from skarn.operators import graph


def assemble(hits: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, evidence_id: each hit (node, pos) before its ancestors, nearest first; a node comes once, where it is first.

    Hits are the bounded result of a ranking, so numbering them takes one small window.
    """
    up = graph.ancestors(edges, hits.select("node"), max_depth)
    every = hits.select("node", "pos", F.lit(0).alias("distance")).unionByName(hits.join(up, "node").select(F.col("ancestor").alias("node"), "pos", "distance"))
    first = every.groupBy("node").agg(F.min(F.struct("pos", "distance")).alias("at"))
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at", "node"))
    return first.select("node", F.concat(F.lit("E"), number).alias("evidence_id"))


def distinct_passages(passages: DataFrame) -> DataFrame:
    """The first of the passages (section, page, ord, text) that are alike but for case and white space."""
    key = F.lower(collapse(F.col("text")))
    return passages.groupBy("section", "page", key.alias("key")).agg(F.min_by(F.struct(*passages.columns), "ord").alias("x")).select("x.*")


def retrieval_rows(sections: DataFrame) -> DataFrame:
    """sections (number, title, text) with retrieval_text, its digest and a token estimate."""
    text = F.concat(F.lit("Section "), "number", F.lit(": "), "title", F.lit("\n"), F.coalesce("text", F.lit("")))
    return sections.withColumn("retrieval_text", text).withColumn("retrieval_sha256", F.sha2("retrieval_text", 256)).withColumn("n_tokens", F.greatest(F.lit(1), F.floor((F.length("retrieval_text") + 3) / 4).cast("int")))


def attributed(candidates: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """candidate, evidence_id where the evidence's node is the candidate's own or an ancestor of it."""
    up = graph.ancestors(edges, candidates.select(F.col("candidate").alias("node")))
    allowed = candidates.select("candidate", F.col("candidate").alias("node")).unionByName(up.select(F.col("node").alias("candidate"), F.col("ancestor").alias("node")))
    return allowed.join(evidence, "node").select("candidate", "evidence_id")
