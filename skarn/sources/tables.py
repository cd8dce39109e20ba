"""Tables of a folder of Parquet, and SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """Run SQL in which {name} stands for a table of the folder; other values are bound by name."""
    used = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text)) if n in TABLES}
    return spark.sql(text, args=args or None, **used)
