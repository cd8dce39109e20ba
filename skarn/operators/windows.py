"""Ordered operators as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.shared import written


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    """Number the runs of rows between breaks, from 1. `breaks` may use lag over the same window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("__break", F.coalesce(breaks, F.lit(True)).cast("long"))
    return marked.withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__break")


def before(keys: list[str], order: list[str], column: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


# What asks for the last question once more, with or without "please" on either side.
RETRIES = ("try again", "retry", "retry that", "try that again", "try it again", "answer again", "answer that again", "can you try again", "could you try again", "give it another try")


def is_retry(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[.!?]+$", "")
    return F.regexp_replace(F.regexp_replace(plain, "^please ", ""), " please$", "").isin(*RETRIES)


def bounded_history(turns: DataFrame, key: str, order: str, most_turns: int = 32, most_each: int = 4000, most_all: int = 32_000) -> DataFrame:
    """The newest turns of user and assistant that fit, trimmed, the oldest of them cut to what is left."""
    said = turns.where(F.col("role").isin("user", "assistant")).withColumn("text", F.trim("text")).where(F.length("text") > 0)
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    size = F.least(F.length("text"), F.lit(most_each))
    used = F.coalesce(F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = said.withColumn("age", F.row_number().over(newest)).withColumn("room", F.lit(most_all) - used)
    cut = F.least(F.lit(most_each), F.col("room")).cast("int")
    return placed.where((F.col("age") <= most_turns) & (F.col("room") > 0)).select(key, order, "role", F.substr("text", F.lit(1), cut).alias("content"), "age")


def last_asked(turns: DataFrame, key: str, order: str) -> DataFrame:
    """key, at, said: the last message of the user that is no retry; a conversation without one has no row."""
    asked = turns.where((F.col("role") == "user") & F.col("text").isNotNull() & ~is_retry(F.col("text")))
    return asked.groupBy(key).agg(F.max(order).alias("at"), F.max_by("text", order).alias("said"))


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `__part`: ranges of keys and order, written, so a key's rows lie in as many tasks as they need."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]]).withColumn("__part", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over the rows of their keys up to and with themselves; equal order needs a tie-breaker.

    Sums run within ranges and start from the total of the ranges before, so neither one key nor no key is one task.
    """
    parts = ranged(rows.withColumn("__amount", amount), keys, order)
    totals = parts.groupBy(*keys, "__part").agg(F.sum("__amount").alias("__total"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.withColumn("__start", F.sum("__total").over(before)).drop("__total")
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.withColumn("__own", F.sum("__amount").over(within)).join(start, [*keys, "__part"])
    zero = F.lit(0)
    return summed.withColumn(name, F.coalesce("__start", zero) + F.coalesce("__own", zero)).drop("__part", "__amount", "__own", "__start")


def reserved(rows: DataFrame, key: str, order: str, amount: Column, cap: int) -> DataFrame:
    """key, order, spent, within: each amount in turn is taken if it fits under the cap, else refused and not charged.

    Each step hangs on the one before, so the rows of a key are folded as one sorted array.
    """
    turns = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), amount.cast("long").alias("n")))).alias("turns"))
    state = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<struct<spent:bigint,within:boolean>>").alias("log"))

    def step(s: Column, t: Column) -> Column:
        fits = s["spent"] + t["n"] <= cap
        spent = s["spent"] + F.when(fits, t["n"]).otherwise(0)
        return F.struct(spent.alias("spent"), F.concat(s["log"], F.array(F.struct(spent.alias("spent"), fits.alias("within")))).alias("log"))

    log = F.aggregate("turns", state, step)["log"]
    return turns.select(key, F.explode(F.arrays_zip(F.col("turns"), log.alias("log"))).alias("x")).select(key, F.col("x.turns.at").alias(order), "x.log.spent", "x.log.within")


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """Distinct values of each key with their place of first appearance, from 1."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("first_at"))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("first_at", value)))


def quota(rows: DataFrame, category: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each category."""
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("pick") <= n)
