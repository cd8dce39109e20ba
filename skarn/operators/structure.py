"""Structure of documents: parents, exception blocks, trees of blocks, owners, and splits at headings.

Ordered steps run within a document or chapter, whose rows meet in one task by definition; documents spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import rules
from skarn.functions.text import collapse, let
from skarn.operators.joins import best
from skarn.sources.shared import written

MOST_LEVELS = 256
# What begins an exception block, and what ends one.
MARKER = r"(?i)^exceptions?\s*:"
BOUNDARY = r"^(?:(?i:section)\s+\d{3,4}\s+\S|\d{3,4}(?:\.\d+)+\s+\S|TABLE\s+\d+(?:\.\d+)*(?:\(\d+\))?(?=\s|$)|(?i:exceptions?\s*:|insights|user note))"


def stack_parents(headings: DataFrame, group: str, order: str) -> DataFrame:
    """headings (group, order, node, level) with parent: the nearest heading before it of a lower level, or null.

    The last heading of each level so far is a column of one running window; the parent is the latest of the
    lower levels. The levels are those that the headings have; more than `MOST_LEVELS` kinds of level are an error.
    No pair of headings is formed.
    """
    levels = sorted(r[0] for r in headings.select("level").where("level is not null").distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"there are more than {MOST_LEVELS} levels")
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.last(F.when(F.col("level") == n, F.struct(F.col(order).alias("at"), F.lit(n).alias("of"), F.col("node").alias("node"))), ignorenulls=True).over(w) for n in levels]
    if not seen:
        return headings.withColumn("parent", F.lit(None).cast(headings.schema["node"].dataType))
    lasts = headings.withColumn("__seen", F.array(*seen))
    return lasts.withColumn("parent", F.array_max(F.filter("__seen", lambda x: x["of"] < F.col("level")))["node"]).drop("__seen")


def exception_blocks(lines: DataFrame, group: str = "doc_id", order: str = "line_index") -> DataFrame:
    """Each exception marker with the lines up to the next heading, caption, marker or note: first line, last line, text, items.

    Inside a block, a line that is a number alone begins an item; lines before the first number belong to none.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = rules.without_prefix(F.col("text"))
    edge = plain.rlike(BOUNDARY)
    cut = lines.select(group, order, collapse(F.col("text")).alias("text"), plain.alias("plain"), edge.alias("edge"))
    numbered = cut.withColumn("block", F.sum(F.col("edge").cast("int")).over(w))
    marker = F.first(F.when(F.col("edge"), F.col("plain").rlike(MARKER)), ignorenulls=True).over(Window.partitionBy(group, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = numbered.withColumn("marked", marker).where("marked")
    within = Window.partitionBy(group, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.nullif(F.regexp_extract("plain", r"^(\d+)\.?$", 1), F.lit(""))
    itemed = inside.withColumn("number", number).withColumn("item", F.last("number", ignorenulls=True).over(within)).withColumn("n_item", F.count("number").over(within))
    row = F.struct(F.col(order).alias("at"), "text", "item", "n_item", F.col("number").isNotNull().alias("is_number"))
    blocks = itemed.groupBy(group, "block").agg(F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.array_sort(F.collect_list(row)).alias("rows"))

    def items(rows: Column) -> Column:
        places = F.array_distinct(F.transform(F.filter(rows, lambda r: (r["n_item"] > 0) & ~r["is_number"]), lambda r: F.struct(r["n_item"].alias("n"), r["item"].alias("number"))))
        return F.transform(places, lambda p: F.struct(p["number"].alias("number"), F.array_join(F.transform(F.filter(rows, lambda r: (r["n_item"] == p["n"]) & ~r["is_number"]), lambda r: r["text"]), " ").alias("text")))

    return blocks.select(group, "first_line", "last_line", F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text"), items(F.col("rows")).alias("items"))


def flattened(blocks: DataFrame, group: str = "doc_id") -> DataFrame:
    """Trees of blocks (group, node, parent, ord) in reading order: node, depth, ordinal from 0; a parent comes before its children.

    Trees are followed to their leaves; blocks that no root reaches have no place.
    """
    level = blocks.where("parent is null").select(group, "node", F.array("ord").alias("path"))
    step = blocks.where("parent is not null").select(group, "parent", F.col("node").alias("child"), "ord")
    every = level
    while True:
        level = written(level.join(step, (level[group] == step[group]) & (level["node"] == step["parent"])).select(level[group], F.col("child").alias("node"), F.concat("path", F.array("ord")).alias("path")), "level")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.select(group, "node", (F.size("path") - 1).alias("depth"), (F.row_number().over(Window.partitionBy(group).orderBy("path", "node")) - 1).alias("ordinal"))


def table_sections(tables: DataFrame, sections: DataFrame, group: str = "doc_id") -> DataFrame:
    """tables (group, table_id, number, at) with the section (group, number, at) that each belongs to.

    A section of the same series goes first, then the nearest before the table, then the nearest behind it.
    """
    s = sections.select(group, F.col("number").alias("section"), F.col("at").alias("s_at"))
    both = tables.join(s, group, "left")
    series = rules.same_series(F.substring_index("number", "(", 1), F.col("section"))
    rank = F.when(series, 0).when(F.col("s_at") <= F.col("at"), 1).otherwise(2)
    return best(both, [group, "table_id"], [rank, F.abs(F.col("s_at") - F.col("at")), F.col("section")]).select(group, "table_id", "number", "section")


def _places(text: Column, headings: Column) -> Column:
    """(at, heading) of the first place of each heading in the text, kept left to right where they do not overlap."""
    found = F.array_sort(F.filter(F.transform(headings, lambda h: F.struct(F.position(h, text).alias("at"), (-F.length(h)).alias("shorter"), h.alias("heading"))), lambda x: x["at"] > 0))
    none = F.array().cast("array<struct<at:int,heading:string>>")
    taken = F.aggregate(
        found,
        F.struct(F.lit(0).alias("end"), none.alias("kept")),
        lambda s, x: F.when(x["at"] > s["end"], F.struct((x["at"] + F.length(x["heading"]) - 1).alias("end"), F.concat(s["kept"], F.array(F.struct(x["at"].alias("at"), x["heading"].alias("heading")))).alias("kept"))).otherwise(s),
    )
    return taken["kept"]


def split_at_headings(blocks: DataFrame) -> DataFrame:
    """blocks (block_id, text, headings: known heading texts) as parts: block_id, part, heading (null before the first), text."""

    def parts(places: Column) -> Column:
        before = F.when(F.coalesce(F.get(places, F.lit(0))["at"], F.lit(2)) > 1, F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.substr("text", F.lit(1), F.coalesce(F.get(places, F.lit(0))["at"] - 1, F.length("text"))).alias("text")))).otherwise(F.array().cast("array<struct<heading:string,text:string>>"))
        after = F.transform(places, lambda p, i: F.struct(p["heading"].alias("heading"), F.substr("text", p["at"], F.coalesce(F.get(places, i + 1)["at"], F.length("text") + 1) - p["at"]).alias("text")))
        return F.concat(before, after)

    cut = blocks.select("block_id", F.posexplode(let(_places(F.col("text"), F.col("headings")), parts)).alias("part", "x"))
    return cut.select("block_id", "part", "x.heading", F.trim("x.text").alias("text")).where("text <> ''")


def owned_text(text: Column, own: Column, others: Column) -> Column:
    """The part of a text from its own heading up to the first other heading behind it; all of it where its own does not occur."""
    start = F.position(own, text)
    tail = F.substr(text, F.greatest(start, F.lit(1)))
    ends = F.filter(F.transform(others, lambda o: F.position(o, F.substr(tail, F.length(own) + 1))), lambda p: p > 0)
    return F.trim(F.when(start == 0, text).otherwise(let(F.array_min(ends), lambda e: F.when(e.isNull(), tail).otherwise(F.substr(tail, F.lit(1), e + F.length(own) - 1)))))


def owner_plan(requirements: DataFrame, owners: DataFrame, splits: DataFrame) -> DataFrame:
    """requirements (req, section, block, span) with new_section and action.

    A block that was split gives its section by the exact span, if that names just one; else the block's owner
    (block, owner) counts; where neither is known the requirement goes to quarantine.
    """
    one = splits.groupBy("block", "span").agg(F.min("owner").alias("split_owner"), F.max("owner").alias("__max"))
    known = requirements.join(one, ["block", "span"], "left").join(owners.select("block", "owner"), "block", "left")
    found = F.when(F.col("split_owner").isNotNull(), F.when(F.col("split_owner") == F.col("__max"), F.col("split_owner"))).otherwise(F.col("owner"))
    planned = known.withColumn("new_section", F.coalesce(found, F.lit("section:unassigned")))
    action = F.when(F.col("new_section") == F.col("section"), "keep").when(F.col("new_section") == "section:unassigned", "quarantine").otherwise("move")
    return planned.select("req", "section", "new_section", action.alias("action"))


def sorted_out(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with `reason`: the first check that failed)."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def reclassified(blocks: DataFrame) -> DataFrame:
    """blocks (block_id, block_type, text): those that hold a second heading become 'unparsed', with the reason."""
    bad = rules.mixed(F.col("text"))
    return blocks.select("block_id", F.when(bad, "unparsed").otherwise(F.col("block_type")).alias("block_type"), F.when(bad, "mixed structural content").alias("failure"))


def supplemented(own: DataFrame, other: DataFrame, key: str, order: list[str]) -> DataFrame:
    """own with the rows of an independent inventory whose key it lacks, numbered anew in order."""
    more = other.join(own.select(key).distinct(), key, "left_anti").withColumn("source", F.lit("inventory"))
    both = own.withColumn("source", F.lit("own")).unionByName(more.select(*own.columns, "source"))
    group, *rest = order
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*rest, key)) - 1)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each changed value: key, field, before, after."""
    both = old.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns]).join(new.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns]), key)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in columns])
    return both.select(key, F.inline(F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))))
