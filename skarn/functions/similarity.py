"""Functions of text that Spark has no built-in for, in Arrow batches."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

MOST_TARGET_TOKENS = 160
_FOLDED = StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))])


@F.pandas_udf(DoubleType())
def sequence_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 where the tokens of a stand in b side by side, else the matching share of both, over b's first 160 tokens."""

    def one(x, y) -> float:
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        if not x or not y:
            return 0.0
        if f" {' '.join(y)} ".find(f" {' '.join(x)} ") >= 0:
            return 1.0
        return SequenceMatcher(None, x, y[:MOST_TARGET_TOKENS], autojunk=False).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(_FOLDED)
def folded(c: pd.Series) -> pd.DataFrame:
    """Compatibility-folded lower-case text with single spaces, and for each of its characters its place in the original."""
    texts, places = [], []
    for value in c:
        chars, at = [], []
        for i, ch in enumerate(value or ""):
            for f in unicodedata.normalize("NFKC", ch).casefold():
                if not f.isspace():
                    chars.append(f)
                    at.append(i)
                elif chars and chars[-1] != " ":
                    chars.append(" ")
                    at.append(i)
        if chars and chars[-1] == " ":
            chars, at = chars[:-1], at[:-1]
        texts.append("".join(chars))
        places.append(at)
    return pd.DataFrame({"text": texts, "places": places})
