"""The named operations that a caller outside may use, with their arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import rules
from skarn.operators import retrieval
from skarn.operators.refresh import Embed
from skarn.sources import guard

MOST_HITS, MOST_QUESTION = 10, 2000


class Tools:
    """search_tables, vector_search, hybrid_search and general_info over given tables.

    passages: (doc_id, text); vectors: (vec_id, embedding), vec_id being a doc_id; embed turns a question into a vector.
    """

    def __init__(self, spark: SparkSession, passages: DataFrame, vectors: DataFrame, embed: Embed, frames: dict[str, DataFrame] | None = None):
        self.spark, self.passages, self.vectors, self.embed, self.frames = spark, passages, vectors, embed, frames or {}
        self.known: dict[str, Callable] = {"search_tables": self.search_tables, "vector_search": self.vector_search, "hybrid_search": self.hybrid_search, "general_info": self.general_info}

    def execute(self, name: str, arguments: dict):
        """The result of a named operation; unknown names and arguments are errors."""
        if name not in self.known:
            raise ValueError(f"unknown operation {name}")
        return self.known[name](**arguments)

    def search_tables(self, query: str) -> list[dict]:
        return guard.run(self.spark, query, **self.frames)

    def _asked(self, query: str) -> DataFrame:
        if not query.strip() or len(query) > MOST_QUESTION:
            raise ValueError("a question has between 1 and 2000 characters")
        return self.spark.createDataFrame([(self.embed([query])[0],)], "q array<double>")

    def vector_search(self, query: str, top_k: int = 5) -> DataFrame:
        return retrieval.cosine(self.vectors, self._asked(query), k=max(1, min(MOST_HITS, top_k)))

    def hybrid_search(self, query: str, top_k: int = 5) -> DataFrame:
        k = max(1, min(MOST_HITS, top_k))
        legs = [retrieval.ranked(retrieval.lexical(self.passages, query), "doc_id", "lexical"), retrieval.ranked(self.vector_search(query, MOST_HITS), "vec_id", "vector")]
        if retrieval._words(query):
            legs.insert(1, retrieval.ranked(retrieval.bm25(self.passages, query), "doc_id", "fulltext"))
        return retrieval.fuse(legs, k)

    def general_info(self, question: str) -> dict:
        row = self.spark.range(1).select(rules.topic_route(F.lit(question)).alias("x")).first()["x"]
        return {"action": row["action"], "topic": row["topic"]}
