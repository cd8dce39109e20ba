"""Text expressions. All are built-in functions of the JVM, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of white space, in the Unicode sense, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def unicode_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row. An expression that a lambda reads is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """n neighbouring words joined by spaces; none where there are fewer."""
    return let(words, lambda ws: F.when(F.size(ws) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))))


def word_chunks(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping runs of words; every word is in one of them."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " ")))

    return let(F.filter(F.split(c, r"\s+"), lambda w: w != ""), cut)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up, and one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4).cast("int"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A surrogate key that depends on its parts only; null parts count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 20))


def section_number(c: Column) -> Column:
    """The first dotted number of three or four digits, or null."""
    return F.nullif(F.regexp_extract(c, r"\b(\d{3,4}(?:\.\d+)*)\b", 1), F.lit(""))


def section_path(number: Column) -> Column:
    """'901.1.1' as '/901/901.1/901.1.1'."""
    return let(F.split(number, r"\."), lambda parts: F.concat(F.lit("/"), F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")), "/")))


def section_level(number: Column) -> Column:
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1


def natural_key(c: Column) -> Column:
    """The numbers in a string; sorting by them puts 2.10 behind 2.9."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), 0), lambda x: x.cast("int"))


def clean_query(c: Column) -> Column:
    """A user's query without null bytes, runs of white space, tags, and marks repeated more than twice."""
    one_line = collapse(F.replace(c, F.lit("\u0000"), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(one_line, "<[^>]+>", ""), r"(?U)([^\w\s])\1{2,}", "$1$1"))


# What a query may not hold, and the marks of which it may hold only so many.
REFUSED = (r"\bDROP\b", r"\bDELETE\b", r"\bCREATE\b", r"\bMERGE\b", "<script>", "javascript:", r"\x00")
BRACKETS, MOST_BRACKETS, MOST_CHARS, LEAST_CHARS = r"[^{}()\[\]<>]+", 20, 2000, 3


def query_problem(c: Column) -> Column:
    """Why a query is refused, or null."""
    brackets = F.length(F.regexp_replace(c, BRACKETS, ""))
    refused = c.rlike("(?i)" + "|".join(REFUSED))
    return F.when(c.isNull() | (F.length(F.trim(c)) == 0), "empty").when(F.length(c) > MOST_CHARS, "too long").when(F.length(c) < LEAST_CHARS, "too short").when(refused, "not allowed").when(brackets > MOST_BRACKETS, "too many special characters")


def percentage(n: Column, d: Column) -> Column:
    """Of d, to six decimals; 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.round(100.0 * n / d, 6))


def ratio(n: Column, d: Column, empty: float = 1.0) -> Column:
    return F.when(d == 0, F.lit(empty)).otherwise(n / d)
