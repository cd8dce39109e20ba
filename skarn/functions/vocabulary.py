"""Names of things as canonical terms: by synonym exactly, else by likeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from skarn.sources.shipping import ship


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded text; Spark has no built-in for it."""
    return c.str.normalize("NFKC").str.casefold()


def exact(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """term, canonical of terms; where a synonym has several canonicals the last by place wins."""
    one = synonyms.groupBy(F.lower("synonym").alias("key")).agg(F.max_by("canonical", "place").alias("canonical"))
    return terms.join(one, F.lower("term") == F.col("key"), "left").select("term", "canonical")


def fuzzy(terms: DataFrame, synonyms: DataFrame, least: float = 0.8) -> DataFrame:
    """term, canonical, score: the likeliest synonym of at least `least`, the first by place of equals.

    Pairs meet by a shared pair of letters: two strings without one have no likeness worth a name.
    """
    ship(terms.sparkSession)
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    a = terms.select("term", F.explode(pairs(F.lower("term"))).alias("k"))
    b = synonyms.select("synonym", "canonical", "place", F.explode(pairs(F.lower("synonym"))).alias("k"))
    met = a.join(b, "k").select("term", "synonym", "canonical", "place").distinct().withColumn("score", F.round(likeness(F.lower("term"), F.lower("synonym")), 6))
    best = met.where(F.col("score") >= least).groupBy("term").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "canonical")).alias("x"))
    return best.select("term", "x.canonical", "x.score")
