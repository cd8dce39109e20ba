"""Reconciling source lines with extracted targets, and reports on what is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.similarity import sequence_likeness
from skarn.functions.text import collapse, percentage, ratio, tokens
from skarn.operators.extraction import box_gap, box_overlap
from skarn.operators.joins import asof, best, line_coverage, rare_coverage

SECTION = r"^\d{3,4}(?:\.\d+)*\.?\s+\S"
CATEGORIES = ("section_heading", "table_caption", "equation", "exception", "insights", "user_note", "table_footnote_candidate", "navigation_artifact", "cross_reference", "source_artifact", "normative_or_commentary_text")


# The height of a page, of its margins, and what stands in them to lead a reader about.
PAGE_HEIGHT, MARGIN = 792.0, 55.0
NAVIGATION = r"(?i)^\d{1,4}\.?$|\b(?:contents|table\s+of\s+contents|index|go\s+to|previous|next|page\s+\d+)\b"


def navigation(text: Column, top: Column, bottom: Column, height: float = PAGE_HEIGHT) -> Column:
    """Whether a line is navigation: it says so, and it lies in the upper or lower margin; without a place it is not."""
    margin = (top <= MARGIN) | (bottom >= height - MARGIN)
    return F.coalesce(margin & collapse(text).rlike(NAVIGATION), F.lit(False))


def line_category(text: Column, top: Column | None = None, bottom: Column | None = None) -> Column:
    """The first of the line categories whose rule holds."""
    t = collapse(text)
    leads = F.lit(False) if top is None else navigation(text, top, F.lit(0.0) if bottom is None else bottom)
    return (
        F.when(t.rlike(SECTION), "section_heading")
        .when(t.rlike(r"(?i)^table\s+\d"), "table_caption")
        .when(t.rlike(r"(?i)^\(?equation\s+\d|^[A-Za-z]\w*\s*=\s*\S"), "equation")
        .when(t.rlike(r"(?i)^exceptions?\b"), "exception")
        .when(t.rlike(r"(?i)^insights?\b"), "insights")
        .when(t.rlike(r"(?i)^user notes?\b"), "user_note")
        .when(t.rlike(r"^[a-z]\.\s|^(?i:for si:)"), "table_footnote_candidate")
        .when(leads, "navigation_artifact")
        .when(t.rlike(r"(?i)^see\s+(section|table|chapter)\b"), "cross_reference")
        .when(t.rlike(r"\x{FFFD}|^\W*$"), "source_artifact")
        .otherwise("normative_or_commentary_text")
    )


def meaningful(text: Column, category: Column) -> Column:
    return (F.length(collapse(text)) >= 5) & (category != "navigation_artifact")


def unparseable(text: Column) -> Column:
    """Control or replacement characters, or hardly a letter or digit in ten characters or more."""
    size = F.length(text)
    return text.rlike(r"[\x00-\x08\x0E-\x1F\x{FFFD}]") | ((size >= 10) & (F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) < 0.12 * size))


def table_rows(lines: DataFrame) -> DataFrame:
    """Lines (table_id, line_index, text) as groups between blank lines: group, row, is_header; 'For SI' lines are no rows."""
    w = Window.partitionBy("table_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.length(collapse(F.col("text"))) == 0
    numbered = lines.withColumn("group", F.sum(blank.cast("int")).over(w)).where(~blank & ~F.col("text").rlike(r"(?i)^\s*for si:"))
    row = F.row_number().over(Window.partitionBy("table_id", "group").orderBy("line_index"))
    return numbered.withColumn("row", row).withColumn("is_header", F.col("row") == 1).withColumn("cells", F.split(F.trim("text"), r"\s{2,}|\t"))


def stitched(fragments: DataFrame) -> DataFrame:
    """Fragments (number, page, row, cells) of one table as one: repeated header rows go, rows are numbered anew."""
    w = Window.partitionBy("number").orderBy("page", "row")
    first = F.first("cells").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = fragments.withColumn("first", first).withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) | ~F.col("cells").eqNullSafe(F.col("first")))
    return kept.select("number", (F.row_number().over(w) - 1).alias("row_index"), "cells")


def token_overlap(source: Column, target: Column) -> Column:
    """Share of the source's distinct tokens that the target has."""
    a, b = F.array_distinct(tokens(source)), F.array_distinct(tokens(target))
    return ratio(F.size(F.array_intersect(a, b)), F.size(a), 0.0)


def span_matches(lines: DataFrame, targets: DataFrame, least: float = 0.6, least_tokens: int = 3) -> DataFrame:
    """Each line (line_id, section, page, text) with its best target (target_id, ord, t_page, target) of its section.

    The score is 0.56 coverage + 0.18 containment + 0.10 nearness of pages + 0.18 for the same section. Lines meet only
    targets of their section, so pairs stay within it.
    """
    page = F.abs(F.col("page") - F.col("t_page"))
    near = F.when(page == 0, 1.0).when(page == 1, 0.6).when(page == 2, 0.25).otherwise(0.0)
    within = F.when(F.contains(F.lower(collapse(F.col("target"))), F.lower(collapse(F.col("text")))), 1.0).otherwise(0.0)
    both = lines.where(F.size(F.array_distinct(tokens(F.col("text")))) >= least_tokens).join(targets, "section").withColumn("coverage", token_overlap(F.col("text"), F.col("target")))
    scored = both.where(F.col("coverage") >= least).withColumn("score", F.round(0.56 * F.col("coverage") + 0.18 * within + 0.10 * near + 0.18, 6))
    return best(scored, ["line_id"], [F.desc("score"), F.col("ord"), F.col("target_id")]).select("line_id", "target_id", F.round("coverage", 6).alias("coverage"), "score")


def span_matches_anywhere(lines: DataFrame, targets: DataFrame, least: float = 0.6, least_tokens: int = 3) -> DataFrame:
    """Each line (line_id, text) without section and page with its best target (target_id, ord, target) of all.

    The score is 0.56 coverage + 0.18 containment. Few targets go to every task, and only matched lines leave it; lines
    and many targets meet on rare tokens of theirs. See token_coverage.
    """
    texts = targets.select("target_id", F.col("target").alias("text"))
    met = line_coverage(lines.dropna(subset=["line_id"]), texts, ["line_id", "text"], ["target_id"], least, least_tokens)
    if met is None:
        long = lines.where(F.size(F.array_distinct(tokens(F.col("text")))) >= least_tokens)
        met = rare_coverage(long, texts, ["line_id"], ["target_id"], least).join(long, "line_id")
    both = met.withColumnRenamed("share", "coverage").join(targets, "target_id")
    within = F.when(F.contains(F.lower(collapse(F.col("target"))), F.lower(collapse(F.col("text")))), 1.0).otherwise(0.0)
    scored = both.withColumn("score", F.round(0.56 * F.col("coverage") + 0.18 * within, 6))
    return best(scored, ["line_id"], [F.desc("score"), F.col("ord"), F.col("target_id")]).select("line_id", "target_id", F.round("coverage", 6).alias("coverage"), "score")


def placed_matches(lines: DataFrame, targets: DataFrame, least: float = 0.6, least_tokens: int = 3) -> DataFrame:
    """span_matches with places: lines have a box, targets (target_id, section, ord, t_page, target, t_box, body).

    The score is 0.56 coverage + 0.18 likeness of the sequences + 0.10 nearness of pages + 0.08 overlap or nearness of the
    boxes, whichever is more, on one page + 0.18 for the section + 0.06 for its chapter + 0.08 for body text.
    """
    page = F.abs(F.col("page") - F.col("t_page"))
    near = F.when(page == 0, 1.0).when(page == 1, 0.6).when(page == 2, 0.25).otherwise(0.0)
    both = lines.where(F.size(F.array_distinct(tokens(F.col("text")))) >= least_tokens).join(targets, "section").withColumn("coverage", token_overlap(F.col("text"), F.col("target"))).where(F.col("coverage") >= least)
    place = F.greatest(F.coalesce(box_overlap(F.col("box"), F.col("t_box")), F.lit(0.0)), F.coalesce(1 / (1 + box_gap(F.col("box"), F.col("t_box")) / 100), F.lit(0.0)))
    alike = both.withColumn("likeness", sequence_likeness(tokens(F.col("text")), tokens(F.col("target"))))
    score = 0.56 * F.col("coverage") + 0.18 * F.col("likeness") + 0.10 * near + 0.08 * F.when(page == 0, place).otherwise(0.0) + 0.24 + F.when(F.col("body"), 0.08).otherwise(0.0)
    return best(alike.withColumn("score", F.round(score, 6)), ["line_id"], [F.desc("score"), F.col("ord"), F.col("target_id")]).select("line_id", "target_id", F.round("coverage", 6).alias("coverage"), "score")


def residual_tokens(matches: DataFrame, lines: DataFrame, targets: DataFrame) -> DataFrame:
    """line_id, residual: tokens of matched lines that their target lacks; they are kept, not dropped."""
    both = matches.join(lines, "line_id").join(targets.select("target_id", "target"), "target_id")
    return both.select("line_id", F.array_except(F.array_distinct(tokens(F.col("text"))), tokens(F.col("target"))).alias("residual")).where("size(residual) > 0")


def report(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """category, n, matched, percent of lines (line_id, category)."""
    joined = lines.join(matches.select("line_id", F.lit(True).alias("found")), "line_id", "left")
    counted = joined.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("matched"))
    return counted.select("category", "n", "matched", percentage(F.col("matched"), F.col("n")).alias("percent"))


def footnote_owner(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Each footnote line (line_id, page, top) with the table (table_id, page, bottom) above it that ends nearest.

    A table below the line costs 1000 more. Only the nearest above and the nearest below can be it, and as-of joins
    find both, so a page's lines and tables are not paired.
    """
    ends = tables.groupBy("page", F.col("bottom").alias("at")).agg(F.min("table_id").alias("table_id")).withColumn("end", F.struct("at", "table_id"))
    above = asof(lines.withColumn("at", F.col("top")), ends, ["page"], ["at"], {"above": "end"})
    both = asof(above.withColumn("at", -F.col("top")), ends.withColumn("at", -F.col("at")), ["page"], ["at"], {"below": "end"}, strict=True)
    found = F.array_compact(F.array(F.when(F.col("above").isNotNull(), F.struct((F.col("top") - F.col("above.at")).alias("cost"), F.col("above.table_id").alias("table_id"))), F.when(F.col("below").isNotNull(), F.struct((1000 - F.col("top") + F.col("below.at")).alias("cost"), F.col("below.table_id").alias("table_id")))))
    return both.where("above is not null or below is not null").select("line_id", F.array_min(found)["table_id"].alias("table_id"))
