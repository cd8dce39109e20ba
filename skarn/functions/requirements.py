"""Clauses of regulatory text as requirement records, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import collapse, stable_id

# Cues, conditions, bodies of standards, references and values that requirements are read by.
CUE = r"(?i)\b(shall not|must not|may not|shall|must|may|is required to|are required to|prohibited|permitted)\b"
CONDITION = r"(?i)\b((?:where|when|if|unless|provided that|except when)\b.*)$"
_BODIES = "ASHRAE|NFPA|ANSI|ASTM|UL|NSF|IMC|IECC|ICC|CSA|ARI|AHRI|AGA|ISO|SMACNA|OSHA|ACGIH"
REFERENCES = {
    "section": r"(?i)\bsections?\s+(\d{3,4}(?:\.\d+)*(?:\(\d+\))?)",
    "table": r"(?i)\btables?\s+(\d+(?:\.\d+)*(?:\(\d+\))?)",
    "chapter": r"(?i)\bchapters?\s+(\d{1,2})\b",
    "equation": r"(?i)\beq(?:uation|\.)?\s*(\d+\s*[-–]\s*\d+)",
    "standard": rf"\b((?:{_BODIES})(?:\s+[A-Z]?\d[\w.-]*)?)",
}
VALUE = r"(?i)([+-]?\d+(?:,\d{3})*(?:\.\d+)?(?:\s+\d+/\d+|/\d+)?)\s*-?\s*(cfm|m3/s|square feet|ft2|m2|°f|degrees f|°c|mm|cm|inch(?:es)?|in\.|feet|foot|ft|met(?:er|re)s?|percent|%|psi|pascals?|pa|kg|seconds?|minutes?|hours?)(?:\b|(?<=[%.]))"
_NOUNS = r"\b(devices?|detectors?|alarms?|dampers?|valves?|fans?|systems?|equipment|appliances?)\b"


def clauses(text: Column) -> Column:
    """Clauses end at a semicolon, a sentence's end, or an "and" before a modal verb."""
    parts = F.split(text, r"(?i);\s*|(?<=[.!?])\s+(?=[A-Z])|\s+and\s+(?=(?:shall|must|may)\b)")
    return F.filter(F.transform(parts, collapse), lambda x: x != "")


def predicate(clause: Column) -> Column:
    """The kind of requirement; the first rule that holds decides."""
    c = F.lower(clause)
    has = lambda p: c.rlike(rf"\b({p})\b")
    modal = has("shall|must|required")
    return (
        F.when(has("shall not|must not|may not|prohibited|not be permitted"), "PROHIBITED_IN")
        .when(has("clearances?") & has("shall|must|required|minimum|not less"), "REQUIRES_CLEARANCE")
        .when(has("in accordance with|comply|compliance|conform"), "MUST_COMPLY_WITH")
        .when(has("minimum|not less than|at least|no less than"), "MINIMUM")
        .when(has("maximum|not more than|not exceed|at most"), "MAXIMUM")
        .when(has("permitted|allowed|may") & ~has("may not"), "PERMITTED_IN")
        .when(c.rlike(_NOUNS) & modal, "REQUIRES_DEVICE")
        .when(modal, "REQUIRES")
    )


def references(text: Column) -> Column:
    """Distinct (kind, value) of sections, tables, chapters, equations and standards named in a text."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), collapse(v).alias("value")))
    return F.array_distinct(F.concat(*[found(k, p) for k, p in REFERENCES.items()]))


def _entity(c: Column) -> Column:
    cut = F.regexp_replace(collapse(c), r"^(?:\d+\.|[a-z]\.)\s*|^[ ,:]+|[ ,:.]+$", "")
    return F.when((F.length(cut) >= 2) & cut.rlike("[A-Za-z]"), cut)


def requirements(spans: DataFrame, skip: tuple[str, ...] = ("table_reference", "equation_reference")) -> DataFrame:
    """spans (document_id, span_id, source_type, text) as one row per requirement clause.

    A clause without a predicate is none. Subject and object lie on either side of the first modal cue; where one
    is missing the row needs review.
    """
    clause = spans.where(~F.col("source_type").isin(*skip)).select("document_id", "span_id", "source_type", F.posexplode(clauses(F.col("text"))).alias("ordinal", "clause"))
    known = clause.withColumn("predicate", predicate(F.col("clause"))).where("predicate is not null")
    cue = F.regexp_substr("clause", F.lit(CUE))
    at = F.regexp_instr("clause", F.lit(CUE))
    head = F.when(at > 0, F.substr("clause", F.lit(1), at - 1))
    tail = F.when(at > 0, F.substr("clause", at + F.length(cue)))
    parsed = known.withColumn("cue", cue).withColumn("subject", _entity(head)).withColumn("object", _entity(F.regexp_replace(tail, CONDITION, "")))
    review = F.col("subject").isNull() | F.col("object").isNull()
    value = F.regexp_substr("clause", F.lit(VALUE))
    return parsed.select(
        stable_id("requirement", *[F.col(c) for c in ("document_id", "span_id", "ordinal", "predicate", "clause")]).alias("requirement_id"),
        "document_id",
        "span_id",
        "ordinal",
        "clause",
        "predicate",
        "subject",
        "object",
        F.nullif(F.regexp_extract("clause", CONDITION, 1), F.lit("")).alias("condition"),
        value.alias("value"),
        references(F.col("clause")).alias("references"),
        ((F.col("source_type") == "exception") | F.lower("clause").rlike(r"\b(exception|except|unless|provided that)\b")).alias("has_exception"),
        F.when(review, 0.68).otherwise(0.82).alias("confidence"),
        review.alias("needs_review"),
    ).dropDuplicates(["requirement_id"])
