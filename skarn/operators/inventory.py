"""An inventory of source lines that does not rest on a parser: headings, captions, equations, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import rules
from skarn.functions.text import collapse, natural_key

# Patterns, and the font sizes and flag that make a line a heading or a caption.
TOP = r"(?i)^section\s+(\d{3,4})\s+(.+?)\s*$"
NUMBERED = r"^(\d{3,4}(?:\.\d+)+)\s+(.+?)\s*$"
CAPTION = r"^(?:\[[A-Z]+\]\s*)?TABLE\s+(\d+(?:\.\d+)*(?:\(\d+\))?)(?=\s|$)\s*(.*)$"
EQUATION = r"(?i)\b(?:Equation|Eq\.?)\s*(\d+)\s*[-–]\s*(\d+)"
TOP_FONT, BOLD_FONT, CAPTION_FONT, BOLD = 16, 13, 12, 20


def _parts(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract(text, pattern, 1).alias("number"), F.regexp_replace(collapse(F.regexp_extract(text, pattern, 2)), r"\.+$", "").alias("title"))


def _first_seen(found: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy("doc_id", *keys).orderBy("line_index")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, number, title, kind, page, line_index of lines (doc_id, line_index, page, text, max_font_size, flags): each (number, title) where it is first."""
    text = rules.without_prefix(F.col("text"))
    large = F.col("max_font_size") >= TOP_FONT
    bold = (F.col("max_font_size") >= BOLD_FONT) & (large | F.array_contains("flags", BOLD))
    found = F.when(text.rlike(TOP) & large, F.struct(F.lit("top_level_section").alias("kind"), _parts(text, TOP).alias("x"))).when(text.rlike(NUMBERED) & bold, F.struct(F.lit("numbered_section").alias("kind"), _parts(text, NUMBERED).alias("x")))
    got = lines.select("doc_id", "line_index", "page", found.alias("f")).where("f is not null").select("doc_id", "f.x.number", "f.x.title", "f.kind", "page", "line_index")
    return _first_seen(got, ["number", "title"])


def captions(lines: DataFrame) -> DataFrame:
    """doc_id, number, title, page, line_index, next_line: table captions, and the line where the next one begins (null: none does)."""
    text = collapse(F.col("text"))
    got = lines.where(text.rlike(CAPTION) & (F.col("max_font_size") >= CAPTION_FONT)).select("doc_id", _parts(text, CAPTION).alias("x"), "page", "line_index").select("doc_id", "x.number", "x.title", "page", "line_index")
    return _first_seen(got, ["number", "page"]).withColumn("next_line", F.lead("line_index").over(Window.partitionBy("doc_id").orderBy("line_index")))


def equations(lines: DataFrame) -> DataFrame:
    """doc_id, number ('chapter-n'), page, context: the first line that names each equation."""
    got = lines.where(F.col("text").rlike(EQUATION)).select("doc_id", F.concat_ws("-", F.regexp_extract("text", EQUATION, 1), F.regexp_extract("text", EQUATION, 2)).alias("number"), "page", collapse(F.col("text")).alias("context"), "line_index")
    return _first_seen(got, ["number"]).drop("line_index")


def numbers(found: DataFrame) -> DataFrame:
    """Distinct numbers of a document in natural order, with their place."""
    return found.select("doc_id", "number").distinct().select("doc_id", "number", F.row_number().over(Window.partitionBy("doc_id").orderBy(natural_key(F.col("number")), "number")).alias("place"))


def table_records(tables: DataFrame, rows: DataFrame, notes: DataFrame) -> DataFrame:
    """tables (table_id, title), rows (table_id, row_index, cells), notes (table_id, n, note) as text: title, rows with cells joined, footnotes, in order."""
    cells = F.array_join(F.transform("cells", lambda c: F.coalesce(collapse(c), F.lit(""))), " | ")
    part = lambda df, kind, at, text: df.select("table_id", F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("n")).alias("at"), text.alias("text"))
    body = rows.where(F.exists("cells", lambda c: F.length(F.trim(c)) > 0))
    every = part(tables, 0, F.lit(0), F.col("title")).unionByName(part(body, 1, F.col("row_index"), cells)).unionByName(part(notes, 2, F.col("n"), F.concat(F.lit("Footnote: "), "note")))
    return every.where("text is not null").select("table_id", F.row_number().over(Window.partitionBy("table_id").orderBy("at", "text")).alias("ordinal"), "text")
