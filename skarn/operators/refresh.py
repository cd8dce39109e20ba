"""Derived data kept up to date: embeddings by digest, representatives, and changes that apply only to what they were planned on."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.shipping import ship

MOST_BATCH = 128
Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedder(dimension: int = 64) -> Embed:
    """A local embedder: each token adds a sign at a place that its hash gives; unit length. Equal texts give equal vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for token in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % dimension] += 1 if h & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()

    return embed


def embedded(texts: DataFrame, cache: DataFrame, embed: Embed, batch: int = MOST_BATCH) -> DataFrame:
    """sha, embedding for each distinct text (sha, text): from the cache (sha, embedding), or embedded in batches where that lacks it."""
    ship(texts.sparkSession)
    need = texts.groupBy("sha").agg(F.min("text").alias("text")).join(cache.select("sha"), "sha", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = embed([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["sha", "embedding"])

    used = cache.select("sha", F.col("embedding").cast("array<float>").alias("embedding")).join(texts.select("sha"), "sha", "left_semi")
    return used.unionByName(need.mapInArrow(run, "sha string, embedding array<float>"))


def delta(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """sha and state of each digest: reusable, missing from the cache, or orphaned in it."""
    a, b = texts.select("sha").distinct().withColumn("own", F.lit(True)), cache.select("sha").distinct().withColumn("old", F.lit(True))
    return a.join(b, "sha", "full").select("sha", F.when(F.col("old").isNull(), "missing").when(F.col("own").isNull(), "orphaned").otherwise("reusable").alias("state"))


def representatives(rows: DataFrame, key: str, by: str) -> DataFrame:
    """rows with is_representative: the smallest key of each digest, and no other."""
    least = rows.groupBy(by).agg(F.min(key).alias("__least"))
    return rows.join(least, by).withColumn("is_representative", F.col(key) == F.col("__least")).drop("__least")


def mixed_owners(requirements: DataFrame, spans: DataFrame) -> DataFrame:
    """requirements (req, block, section): those of a block that several sections own go to section:unassigned."""
    many = spans.groupBy("block").agg((F.min("section") < F.max("section")).alias("many"))
    both = requirements.join(many, "block", "left")
    return both.select("req", "block", F.when(F.coalesce("many", F.lit(False)), "section:unassigned").otherwise(F.col("section")).alias("section"), F.coalesce("many", F.lit(False)).alias("quarantined"))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Number of rows, and a sum of their hashes that does not depend on their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("h")).first()
    return row["n"], int(row["h"])


def apply(df: DataFrame, planned_on: tuple[int, int], change: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Write the changed table to a new path, if df still is what the change was planned on."""
    if fingerprint(df) != planned_on:
        raise ValueError("the table has changed since the plan was made")
    change(df).write.parquet(path)


def first_per_key(rows: DataFrame, keys: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each asked key; no key can use up the room of another."""
    asked = rows.join(keys.select(key).distinct(), key, "left_semi")
    return asked.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= n)
