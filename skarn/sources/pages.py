"""Tables of page lines. No reader of page files is on the box, so lines come as JSON records of this schema, or are laid out from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "doc_id long, page_no int, line_index int, text string, `left` double, `top` double, `right` double, `bottom` double, max_font_size double, flags array<int>"
TOP, PITCH, CHAR, LINES_A_PAGE = 40.0, 14.0, 6.0, 50


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line records, one JSON object a line of a file; a field of another type is an error."""
    return spark.read.schema(LINES).option("mode", "FAILFAST").json(path)


def laid_out(texts: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """Texts (doc_id, text) as line records: each line at its place on its page, blank lines included."""
    lines = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    on = F.col("at") % lines_a_page
    top = F.lit(TOP) + on * PITCH
    head = F.col("text").rlike(r"^\s*(#|\d{3,4}(\.\d+)*\s+[A-Z])")
    return lines.select("doc_id", (F.floor(F.col("at") / lines_a_page) + 1).cast("int").alias("page_no"), on.cast("int").alias("line_index"), "text", F.lit(TOP).alias("left"), top.alias("top"), (F.lit(TOP) + F.length("text") * CHAR).alias("right"), (top + PITCH).alias("bottom"), F.when(head, 14.0).otherwise(10.0).alias("max_font_size"), F.when(head, F.array(F.lit(20))).otherwise(F.array().cast("array<int>")).alias("flags"))


def page_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, text: a page's lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    return lines.groupBy("doc_id", "page_no").agg(rows.alias("rows")).select("doc_id", "page_no", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    """doc_id, text: a document's pages in order, a form feed between them."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\f").alias("text"))


def one_page(lines: DataFrame, page: Column | int) -> DataFrame:
    """The text of one page of each document; reading stops at the filter."""
    return page_texts(lines.where(F.col("page_no") == page)).select("doc_id", "text")


def page_index(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, n_lines, n_large, box, before: what stands on each page, and how many lines before it."""
    by_page = lines.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("max_font_size") > 12).alias("n_large"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    before = F.sum("n_lines").over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    return by_page.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
