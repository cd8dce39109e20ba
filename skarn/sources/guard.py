"""A guard for queries that come from outside: one bounded read, or a reason why not."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from skarn.sources.shipping import ship

MOST_CHARS, MOST_ROWS, MOST_BYTES = 8000, 100, 160_000
_WRITES = r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace|load|set|reset|cache|refresh|call|grant|revoke|use|add|copy)\b"


def problem(text: str, most_rows: int = MOST_ROWS) -> str | None:
    """None if the text is a single SELECT that ends with a literal LIMIT of at most most_rows."""
    if len(text) > MOST_CHARS:
        return "too long"
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "''", text)
    if re.search(r"--|/\*", bare):
        return "comment"
    bare = bare.strip().rstrip(";").strip()
    if ";" in bare:
        return "more than one statement"
    if not re.match(r"(?i)(select|with)\b", bare):
        return "not a query"
    if re.search("(?i)" + _WRITES, bare):
        return "writes"
    end = re.search(r"(?i)\blimit\s+(\d+)\s*$", bare)
    if not end:
        return "no limit at its end"
    if any(int(n) > most_rows for n in re.findall(r"(?i)\blimit\s+(\d+)", bare)):
        return f"limit above {most_rows}"
    return None


def problems(queries, key: str, column: str):
    """key, problem of a table of queries; the check runs in Arrow batches."""
    ship(queries.sparkSession)

    def check(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([problem(q or "") for q in b.column(1).to_pylist()], pa.string())], names=[key, "problem"])

    return queries.select(F.col(key).cast("long").alias(key), F.col(column).cast("string").alias("q")).mapInArrow(check, f"{key} long, problem string")


def bounds(df, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES):
    """One row: whether a result keeps within its bounds. Rows beyond the bound are not read."""
    size = F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])) + 2
    counted = df.limit(most_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return counted.select(F.when(F.col("n") > most_rows, "too many rows").when(F.col("bytes") > most_bytes, "too many bytes").otherwise("ok").alias("status"))


def run(spark, text: str, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, **frames):
    """Rows of a guarded query as dicts. Too many rows or bytes are an error, not a cut."""
    if why := problem(text, most_rows):
        raise ValueError(why)
    rows = [r.asDict(recursive=True) for r in spark.sql(text, **frames).limit(most_rows + 1).collect()]
    if len(rows) > most_rows or len(str(rows).encode()) > most_bytes:
        raise ValueError("the result is too large")
    return rows
