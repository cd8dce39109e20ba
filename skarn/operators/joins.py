"""Joins that a plain equality cannot say: as-of, best match, overlap, coverage, consume-once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from skarn.functions import coverage as C
from skarn.functions.text import tokens
from skarn.sources.shared import written
from skarn.sources.shipping import ship, small_batches

MOST_Y = 1000


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the last non-null value at or before it, within its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], take: dict[str, str], strict: bool = False) -> DataFrame:
    """left with the columns `take` (own name: right's name) of right's last row at or before it.

    Both sides have `keys` and `order`. One pass over the union of both, partitioned by the keys: no range join, and
    nothing grows beyond the rows themselves. strict leaves out rows of equal order.
    """
    value = F.struct(*[F.col(v).alias(k) for k, v in take.items()])
    a = left.withColumn("__side", F.lit(0 if strict else 1))
    b = right.select(*keys, *order, value.alias("__value")).withColumn("__side", F.lit(1 if strict else 0))
    both = a.unionByName(b.withColumn("__right", F.lit(True)), allowMissingColumns=True)
    filled = carry_forward(both, keys, [*order, "__side"], F.col("__value"), "__found")
    return filled.where("__right is null").select(*left.columns, *[F.col("__found")[k].alias(k) for k in take])


def best(scored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return scored.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of equal keys whose closed spans meet.

    Spans are laid on cells of `width`, and pairs meet in the first cell that both have, so the join is an equality
    and each pair comes once. Choose the width near the usual span.
    """
    cell = lambda s: F.explode(F.sequence(F.floor(F.col(s[0]) / width), F.floor(F.col(s[1]) / width)))
    x, y = a.withColumn("__cell", cell(a_span)), b.withColumn("__cell", cell(b_span))
    first = F.greatest(F.floor(F.col(a_span[0]) / width), F.floor(F.col(b_span[0]) / width))
    return x.join(y, [*keys, "__cell"]).where((F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1])) & (F.col("__cell") == first)).drop("__cell")


def overlapping_boxes(a: DataFrame, b: DataFrame, keys: list[str], a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str], width: float, height: float) -> DataFrame:
    """Pairs of equal keys whose closed boxes (left, top, right, bottom) meet; pairs meet in the first cell that both have."""
    at = lambda c, size: F.floor(F.col(c) / size)
    laid = lambda df, box: df.withColumn("__x", F.explode(F.sequence(at(box[0], width), at(box[2], width)))).withColumn("__y", F.explode(F.sequence(at(box[1], height), at(box[3], height))))
    first = (F.col("__x") == F.greatest(at(a_box[0], width), at(b_box[0], width))) & (F.col("__y") == F.greatest(at(a_box[1], height), at(b_box[1], height)))
    meet = (F.col(a_box[0]) <= F.col(b_box[2])) & (F.col(b_box[0]) <= F.col(a_box[2])) & (F.col(a_box[1]) <= F.col(b_box[3])) & (F.col(b_box[1]) <= F.col(a_box[3]))
    return laid(a, a_box).join(laid(b, b_box), [*keys, "__x", "__y"]).where(meet & first).drop("__x", "__y")


def nearest_sum(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, b_id: str, take: str) -> DataFrame:
    """a with `take`: the id of the b row of equal keys that has the least |x - x'| + |y - y'|, the least id of equals.

    For each value of y on b's side the best b has the nearest x below or above, so it is one of two as-of joins a
    value of y. y must have few values (`MOST_Y` at most); a pairs with those values and never with the rows of b.
    """
    values = b.select(*keys, F.col(y).alias("__y")).distinct()
    most = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_Y:
        raise ValueError(f"{y} has {most} values for one key")
    asked = a.join(values, keys)
    ends = b.groupBy(*keys, F.col(y).alias("__y"), F.col(x).alias("__at")).agg(F.min(b_id).alias("__id")).withColumn("__end", F.struct("__at", "__id"))
    below = asof(asked.withColumn("__at", F.col(x)), ends, [*keys, "__y"], ["__at"], {"__below": "__end"})
    both = asof(below.withColumn("__at", -F.col(x)), ends.withColumn("__at", -F.col("__at")), [*keys, "__y"], ["__at"], {"__above": "__end"})
    cost = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.abs(F.col(x) - F.col(c)["__at"]) + F.abs(F.col(y) - F.col("__y"))).alias("cost"), F.col(c)["__id"].alias("id")))
    near = both.withColumn("__best", F.array_min(F.array_compact(F.array(cost("__below"), cost("__above")))))
    return near.where("__best is not null").groupBy(*a.columns).agg(F.min("__best").alias("__best")).withColumn(take, F.col("__best.id")).drop("__best")


def coverage(source: DataFrame, output: DataFrame, key: str, title: str) -> DataFrame:
    """key, n_source, n_output and a status for every key of either side."""
    side = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{n}"), F.min(title).alias(f"{n}_title"))
    both = side(source, "source").join(side(output, "output"), key, "full")
    n_source, n_output = F.coalesce("n_source", F.lit(0).cast("long")), F.coalesce("n_output", F.lit(0).cast("long"))
    status = F.when(n_source == 0, "output_only").when(n_output == 0, "missing").when(n_output > n_source, "duplicate").when(~F.col("source_title").eqNullSafe(F.col("output_title")), "title_mismatch").otherwise("matched")
    return both.select(key, n_source.alias("n_source"), n_output.alias("n_output"), status.alias("status"))


def consume_once(wants: DataFrame, offers: DataFrame, keys: list[str], want_order: str, offer_order: str) -> DataFrame:
    """The n-th want of a key takes its n-th offer; wants beyond the offers get null."""
    nth = lambda df, order: df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return nth(wants, want_order).join(nth(offers, offer_order), [*keys, "__nth"], "left").drop("__nth")


def unique_match(wants: DataFrame, offers: DataFrame, keys: list[str], take: str) -> DataFrame:
    """wants with `take` where a key has exactly one distinct value of it, else null."""
    one = offers.groupBy(*keys).agg(F.min(take).alias(take), F.max(take).alias("__max")).where(F.col(take) == F.col("__max")).drop("__max")
    return wants.join(one, keys, "left")


def token_counts(texts: DataFrame, keys: list[str], once: bool = True) -> DataFrame:
    """keys, w, n: the tokens of texts (keys, text) with their counts, or each once."""
    return _counts(texts.dropna(subset=keys), keys, once)


def _counts(texts: DataFrame, keys: list[str], once: bool) -> DataFrame:
    words = texts.select(*keys, F.explode(tokens(F.col("text"))).alias("w")).where("w is not null")
    return words.groupBy(*keys, "w").agg((F.lit(1).cast("long") if once else F.count(F.lit(1))).alias("n"))


def _few(counts: DataFrame, keys: list[str], most: int) -> C.Index | None:
    """An index of texts by their counts (keys, w, n), or nothing where they have no token or more than `most`."""
    rows = counts.limit(most + 1).toArrow()
    n = rows.column("n").to_numpy()
    return C.Index(rows, keys) if 0 < len(n) <= most and n.sum() <= most else None


def _met(many: DataFrame, index: C.Index, few: DataFrame, keys: list[str], keep: list[str], least: float, once: bool, of_few: bool, least_total: int = 1) -> DataFrame:
    """keep, keys, covered, total of `many` against an index of `few`, in one pass over `many`; rows stand alone."""
    ship(many.sparkSession)
    small_batches(many.sparkSession)
    schema = StructType([many.schema[c] for c in keep] + [few.schema[c] for c in keys]).add("covered", LongType()).add("total", LongType())
    return many.select(*dict.fromkeys([*keep, "text"])).mapInArrow(C.covered(index, keep, schema.names, least, once, of_few, least_total), schema)


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def token_coverage(wants: DataFrame, offers: DataFrame, want: list[str], offer: list[str], least: float, once: bool = True, most: int = C.MOST_TOKENS) -> DataFrame:
    """want, offer, covered, share: all pairs of texts in which offer's tokens cover `least` or more of want's; rows of one key are one text.

    Where the smaller side has `most` tokens or fewer, it goes to every task and each text of the larger is counted against
    it whole: only pairs of the result leave a task. Else both meet on rare tokens, see `rare_coverage`; so do those texts
    of the larger side that lie in several rows.
    """
    of_few = _bytes(wants) <= _bytes(offers)
    (few, few_keys), (many, many_keys) = ((wants, want), (offers, offer)) if of_few else ((offers, offer), (wants, want))
    index = _few(token_counts(few, few_keys, once), few_keys, most)
    if index is None:
        return rare_coverage(wants, offers, want, offer, least, once)
    many = many.dropna(subset=many_keys)
    repeated = written(many.groupBy(*many_keys).count().where("count > 1").select(*many_keys), "repeated")
    split = not repeated.isEmpty()
    met = _met(many.join(repeated, many_keys, "left_anti") if split else many, index, few, few_keys, many_keys, least, once, of_few)
    pairs = met.select(*want, *offer, "covered", (F.col("covered") / F.col("total")).alias("share"))
    if not split:
        return pairs
    rest = many.join(repeated, many_keys, "left_semi")
    return pairs.unionByName(rare_coverage(*((wants, rest) if of_few else (rest, offers)), want, offer, least, once))


def row_coverage(wants: DataFrame, offers: DataFrame, want: list[str], offer: list[str], least: float, once: bool = True, most: int = C.MOST_TOKENS) -> DataFrame:
    """As token_coverage, but each row is a text of its own, whatever its key: one that repeats or is null costs nothing more."""
    of_few = _bytes(wants) <= _bytes(offers)
    (few, few_keys), (many, many_keys) = ((wants, want), (offers, offer)) if of_few else ((offers, offer), (wants, want))
    index = _few(_counts(few.withColumn("row", F.monotonically_increasing_id()), ["row", *few_keys], once), ["row", *few_keys], most)
    if index is None:
        a, b = (written(x.select(*k, "text").withColumn(row, F.monotonically_increasing_id()), row) for x, k, row in ((wants, want, "want_row"), (offers, offer, "offer_row")))
        met = rare_coverage(a, b, ["want_row"], ["offer_row"], least, once)
        return met.join(a.select("want_row", *want), "want_row").join(b.select("offer_row", *offer), "offer_row").select(*want, *offer, "covered", "share")
    index.keys = index.keys.drop_columns("row")
    met = _met(many, index, few, few_keys, many_keys, least, once, of_few)
    return met.select(*want, *offer, "covered", (F.col("covered") / F.col("total")).alias("share"))


def line_coverage(lines: DataFrame, targets: DataFrame, keep: list[str], target: list[str], least: float, least_total: int, most: int = C.MOST_TOKENS) -> DataFrame | None:
    """keep, target, covered, share for each row of lines (text) alone, from `least_total` distinct tokens on; None where the targets have more than `most` tokens."""
    index = _few(token_counts(targets, target), target, most)
    if index is None:
        return None
    return _met(lines, index, targets, target, keep, least, True, False, least_total).select(*keep, *target, "covered", (F.col("covered") / F.col("total")).alias("share"))


def rare_coverage(wants: DataFrame, offers: DataFrame, want: list[str], offer: list[str], least: float, once: bool = True) -> DataFrame:
    """token_coverage for two large sides, by an inverted index.

    An offer that covers so much has one of the want's rarest tokens: of those that leave less than `least` behind
    them. Pairs meet on these only and are then counted on all tokens, so no pair at or above `least` is lost. Offers
    are counted once: all three uses of `postings` read the same columns, so Spark has one exchange for them.
    """
    counts = token_counts(wants, want, once)
    postings = token_counts(offers, offer, once).withColumnRenamed("n", "m").where("m > 0")
    rarity = postings.groupBy("w").agg(F.sum("m").alias("df"))
    by_want = Window.partitionBy(*want)
    ranked = counts.join(rarity, "w", "left").withColumn("total", F.sum("n").over(by_want)).withColumn("upto", F.sum("n").over(by_want.orderBy(F.coalesce("df", F.lit(0).cast("long")), "w").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rare = ranked.where((F.col("upto") - F.col("n") <= F.col("total") - F.ceil(F.lit(least) * F.col("total") - 1e-9)) & F.col("df").isNotNull())
    pairs = rare.select(*want, "w", "total").join(postings, "w").select(*want, *offer, "total").distinct()
    counted = pairs.join(counts, want).join(postings, [*offer, "w"]).groupBy(*want, *offer, "total").agg(F.sum(F.least("n", "m")).alias("covered"))
    return counted.withColumn("share", F.col("covered") / F.col("total")).where(F.col("share") >= least).drop("total")
