"""Structure and relations out of page text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.requirements import REFERENCES, VALUE
from skarn.functions.text import collapse, ngrams, tokens
from skarn.sources.shipping import ship

HEADING = r"(?m)^(\d{3,4}(?:\.\d+){0,5})\.?[ \t]+(\S[^\n]*)$"
_SPANS = "doc_id long, kind string, value string, start int, end int"


def headings(texts: DataFrame) -> DataFrame:
    """(doc_id, text) as doc_id, ordinal, number, title, level: the first heading of each number, in order."""
    found = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(HEADING), 0)).alias("ord", "line"))
    parts = found.select("doc_id", "ord", F.regexp_extract("line", HEADING, 1).alias("number"), collapse(F.regexp_extract("line", HEADING, 2)).alias("title")).where(F.split("number", r"\.")[0].cast("int") >= 100)
    first = parts.groupBy("doc_id", "number").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("ordinal"), "number", "title", (F.size(F.split("number", r"\."))).alias("level"))


def section_contents(texts: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, number, content: the text from each heading to the next, or `most` characters behind the document's last.

    The texts behind several headings of one number are one content, in order.
    """
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    number = F.nullif(F.regexp_extract("line", r"^(\d{3,4}(?:\.\d+)*)\.?[ \t]+\S", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = lines.withColumn("head", number).withColumn("number", F.last("head", ignorenulls=True).over(w)).withColumn("at", F.count("head").over(w)).withColumn("last", F.count("head").over(Window.partitionBy("doc_id")))
    owned = headed.where("number is not null and head is null").groupBy("doc_id", "number", "at", "last").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    parts = owned.withColumn("part", F.when(F.col("at") == F.col("last"), F.substring(joined, 1, most)).otherwise(joined))
    body = parts.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("ps"))
    return body.select("doc_id", "number", F.array_join(F.transform("ps", lambda x: x["part"]), "\n").alias("content"))


def _annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    patterns = {k: re.compile(p) for k, p in (REFERENCES | {"value": VALUE}).items()}
    for batch in batches:
        out = [(i, k, m[0], m.start(), m.end()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, p in patterns.items() for m in p.finditer(t or "")]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "kind", "value", "start", "end"])


def annotations(texts: DataFrame) -> DataFrame:
    """doc_id, kind, value, start, end of values and references. Spark has no match offsets, so this runs in Arrow batches."""
    ship(texts.sparkSession)
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_annotate, _SPANS)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), collapse), lambda s: s != "")


def _named(sentence: Column, names: list[str]) -> Column:
    low = F.lower(sentence)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b{n}\b"), n) for n in names]))


def relations(texts: DataFrame, equipment: list[str], locations: list[str]) -> DataFrame:
    """doc_id, source, type, target, inches: prohibited, permitted, and clearance relations of sentences.

    A negated permission is a prohibition only; feet are told by the unit behind the number, not by letters elsewhere.
    """
    s = texts.select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    low = F.lower("s")
    prohibited = low.rlike(r"\b(shall not|must not|prohibited|not (?:be )?(?:permitted|allowed))\b")
    clearance = F.regexp_extract(low, r"\bclearance\b.*?(\d+)\s*(?:inch(?:es)?|in\.|feet|foot|ft)\b", 1)
    feet = F.regexp_extract(low, r"\bclearance\b.*?\d+\s*(inch(?:es)?|in\.|feet|foot|ft)\b", 1).rlike("^f")
    kind = F.when(clearance != "", "REQUIRES_CLEARANCE").when(prohibited, "PROHIBITED_IN").when(low.rlike(r"\b(permitted|allowed)\b"), "PERMITTED_IN")
    inches = F.when(clearance != "", clearance.try_cast("int") * F.when(feet, 12).otherwise(1))
    typed = s.select("doc_id", kind.alias("type"), inches.alias("inches"), _named(F.col("s"), equipment).alias("e"), _named(F.col("s"), locations).alias("l")).where("type is not null")
    return typed.select("doc_id", "type", "inches", F.explode("e").alias("source"), "l").select("doc_id", "source", "type", F.explode("l").alias("target"), "inches")


def deduplicated_edges(edges: DataFrame, order: str) -> DataFrame:
    """The first edge by order of each (source, type, target)."""
    return edges.groupBy("source", "type", "target").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("source", "type", "target")]), order).alias("x")).select("source", "type", "target", "x.*")


def query_entities(query: str, names: DataFrame) -> DataFrame:
    """name, phrase: phrases of one to four words of a query that are names (column name); the longest first."""
    words = tokens(F.lit(query))
    phrases = F.concat(*[ngrams(words, n) for n in (4, 3, 2, 1)])
    return names.withColumn("at", F.array_position(phrases, F.lower("name"))).where("at > 0").orderBy("at").select("name", F.col("at").cast("int").alias("place"))


def box_overlap(a: Column, b: Column) -> Column:
    """Share of box a (left, top, right, bottom) that b covers; a has an area of 1 at least."""
    w = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0.0))
    h = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))
    return w * h / F.greatest((a["right"] - a["left"]) * (a["bottom"] - a["top"]), F.lit(1.0))


def box_gap(a: Column, b: Column) -> Column:
    """Distance of two boxes; 0 where they meet."""
    dx = F.greatest(b["left"] - a["right"], a["left"] - b["right"], F.lit(0.0))
    dy = F.greatest(b["top"] - a["bottom"], a["top"] - b["bottom"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def formula_key(c: Column) -> Column:
    """A formula without its label and white space, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*\(?equation\s+\d+\s*[-–]\s*\d+\)?\s*:?", ""), r"(?U)\s+", ""))


def resolved(items: DataFrame, body: DataFrame) -> DataFrame:
    """ord, self_ref, label, text of an export's items in the order of its body (ord, ref); unknown refs are dropped rows.

    Text comes from the first of text, orig and content that is there.
    """
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "orig", "content")])
    return body.join(items, body["ref"] == items["self_ref"]).select("ord", "self_ref", "label", text.alias("text"))


def routed(items: DataFrame) -> DataFrame:
    """Items (ord, label, text) with their block type and the last heading before them, or the unassigned section."""
    kind = F.when(F.col("label") == "section_header", "heading").when(F.col("label").isin("page_header", "page_footer"), "furniture").when(F.col("label") == "formula", "equation").when(F.col("text").rlike("(?i)^exceptions?:"), "exception").when(F.col("label") == "list_item", "list").otherwise("paragraph")
    typed = items.withColumn("block_type", kind)
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return typed.withColumn("section", F.coalesce(F.last(F.when(F.col("block_type") == "heading", F.concat(F.lit("section:"), F.split("text", " ")[0])), ignorenulls=True).over(w), F.lit("section:unassigned")))
