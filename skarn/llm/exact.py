"""Exact deduplication by deterministic block naming.

A text's UTF-8 bytes are cut into fixed-size blocks. Distinct blocks are sorted and get integer names; then the
names of adjacent blocks are paired, distinct pairs are sorted and named, and so on until each text has one
name. Equal names on a level mean equal bytes, because a name stands for the block or pair itself and never for
a hash of it: hashes only choose where blocks meet, and blocks that share a hash are told apart by their bytes.

Defined cases: null text counts as empty, and empty texts equal one another; of equal texts the largest doc_id
stays, a null doc_id being smaller than any other; rows that repeat a doc_id and its text count each in
group_size, and `keep` leaves one of them; one doc_id with two texts is two documents; an empty table
gives an empty result; other columns are ignored by `classes` and kept as they are by `keep`, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.scratch import Scratch, released

BLOCK_BYTES = 16384


def _named(keys: DataFrame, order: list[str], name: str = "name") -> DataFrame:
    """Distinct keys with an integer name each: their place in a sorted partition. The caller writes the result."""
    return keys.sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def classes(spark: SparkSession, docs: DataFrame, block_bytes: int = BLOCK_BYTES, meet=F.xxhash64) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size and kept for every row.

    meet: a function of a block's bytes that decides where blocks meet; any function gives the same result.
    """
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), text.cast("binary").alias("raw"))
    n = F.greatest(F.ceil(F.octet_length("raw") / block_bytes), F.lit(1)).cast("int")
    pieces = whole.select("doc_id", "text_sha256", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("raw", i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block")).withColumn("at", meet("block"))

    # Blocks that meet: nearly always one. Each gets a row and a name; the bytes are kept only where there are more.
    met = pieces.groupBy("at").agg(F.collect_set("block").alias("blocks"))
    one = F.size("blocks") == 1
    names = scratch.cut(_named(met.select("at", F.explode(F.when(one, F.array(F.lit(None).cast("binary"))).otherwise(F.array_sort("blocks"))).alias("same")), ["at", "same"]), "names")
    if names.where("same is not null").isEmpty():
        level = pieces.select("doc_id", "text_sha256", "n", "pos", "at").join(names.drop("same"), "at")
    else:
        level = pieces.join(names, (pieces["at"] == names["at"]) & (names["same"].isNull() | (names["same"] == pieces["block"])))
    level = scratch.cut(level.select("doc_id", "text_sha256", "n", "pos", "name", F.lit(1).cast("long").alias("rows")), "level0")

    done = [level.where("n = 1").select("doc_id", "text_sha256", "rows", F.lit(0).alias("depth"), "name")]
    depth, most = 0, level.agg(F.max("n")).first()[0] or 0
    level = level.where("n > 1")
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = scratch.cut(level.groupBy("doc_id", "text_sha256", "n", (F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"), F.max("rows").alias("rows") if depth > 1 else F.count_if(F.col("pos") % 2 == 0).alias("rows")), f"pairs{depth}")
        names = scratch.cut(_named(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("uses")), ["left", "right"]), f"names{depth}")
        level = scratch.cut(pairs.join(names.drop("uses"), ["left", "right"]).select("doc_id", "text_sha256", ((F.col("n") + 1) / 2).cast("int").alias("n"), "pos", "name", "rows"), f"level{depth}")
        scratch.drop(f"pairs{depth}", f"names{depth}")
        done.append(level.where("n = 1").select("doc_id", "text_sha256", "rows", F.lit(depth).alias("depth"), "name"))
        level = level.where("n > 1")

    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    # Written before it is joined: the join then lies right on its two exchanges, where a hot group can be split.
    groups = scratch.cut(every.groupBy("depth", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    out = every.join(groups, ["depth", "name"])
    return out.select("doc_id", "text_sha256", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs, whatever their names."""
    with released():
        kept = classes(spark, docs).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha")).distinct()
        kept = Scratch.apart(spark, "exact-keep").cut(kept, "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha"))
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    return joined.dropDuplicates(["keep_id", "keep_sha"]).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts over all documents."""
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
