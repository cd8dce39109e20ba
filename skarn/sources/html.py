"""Structure of raw HTML pages (page_id, html), by expressions over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import collapse


def plain(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))


def links(pages: DataFrame) -> DataFrame:
    """Distinct targets of each page, with how often they occur."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


def headings(pages: DataFrame) -> DataFrame:
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>.*?</h[1-6]>"), 0)).alias("ordinal", "h"))
    return found.select("page_id", "ordinal", F.substring("h", 3, 1).cast("int").alias("level"), plain(F.regexp_replace("h", "^<h[1-6][^>]*>|</h[1-6]>$", "")).alias("heading"))


def blocks(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), 1)).alias("ordinal", "p")).select("page_id", "ordinal", plain(F.col("p")).alias("block"))


def categories(pages: DataFrame) -> DataFrame:
    """The first category whose rule holds."""
    html = F.col("html")
    return pages.select("page_id", F.when(html.isNull() | (html == ""), "empty").when(~html.rlike(r"(?s)<h1[^>]*>.*?</h1>"), "no_heading").when(html.rlike("(?i)<script"), "script").otherwise("normative").alias("category"))


def dense_rows(cells: DataFrame, width: DataFrame) -> DataFrame:
    """row, cells: sparse (row, col, cell) as arrays with an empty string where there is none; width is one row n_cols."""
    rows = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("have"))
    return rows.join(F.broadcast(width), F.lit(True)).select("row", F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.coalesce(F.col("have")[i], F.lit(""))).alias("cells"))
