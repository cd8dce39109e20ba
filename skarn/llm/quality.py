"""Quality rules with host verdicts, in DataFrame expressions only.

Every text is measured once and judged by five rules (`RULES`). Two of them, the base rules, reject a document wherever
it comes from; the other three only where its host gives cause. The failures of each rule are counted by host, and each
host's rate for each rule is shrunk with a beta prior that is fitted to all hosts by moments. The verdicts of a host:

* rejected: its shrunk rate of a rule, or of the base rules together, is above `most_failed`; all its documents go;
* strict in a rule: its shrunk rate of that rule is at least the mean of the hosts; its documents that fail the rule go.
  On a better host a single failure of such a rule is let pass.

A document is kept if neither its own base rules nor its host's verdicts reject it.

Defined cases: null text has no words and fails; a null host has no verdict, so its documents are judged by
the base rules alone; repeated rows are judged and counted once each; an empty table gives an empty result; a single
host, or hosts that all agree, are strict; columns that the caller's table has besides those read are ignored by the
query and kept by `keep`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL_OTHERS = r"[^#*$%&|<>]+"
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, MOST_FAILED, RUN = 50, 50, 0.8, 3
MAX_SYMBOL_PERCENT, MANY_DUP_LINES, MEAN_WORD = 10, 3, (2, 12)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("few_words", "repeats", "symbols", "same_lines", "odd_words")
SOFT = RULES[2:]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(word_list: Column, run: int = RUN) -> Column:
    """How many words lie in a window of `run` words that occurs more than once in the list.

    Windows are sorted with their places; equal neighbours mark repeats, and each marked place covers up to
    `run` words, less where the next marked place is nearer.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(run)))
        return F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(run).cast("long"), lambda s, x: s + x))

    def places(ordered: Column) -> Column:
        same = lambda i, j: F.get(ordered, i)["w"] == F.get(ordered, j)["w"]
        marked = F.filter(ordered, lambda x, i: ((i > 0) & same(i, i - 1)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(marked, lambda x: x["i"]))

    def of(ws: Column) -> Column:
        starts = F.slice(ws, 1, F.greatest(F.size(ws) - (run - 1), F.lit(0)))
        windows = F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + j) for j in range(1, run)]))
        return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(v, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), lambda o: let(places(o), covered))))

    return let(word_list, of)


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the MEASURES of their texts in place of the text column."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    by_words = let(words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    others = [c for c in rows.columns if c != text]
    return rows.select(
        *others,
        by_words.alias("by_words"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOL_OTHERS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ).select(*others, "by_words.n_words", "word_chars", "n_symbols", "n_dup_lines", "by_words.n_repeat_words")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of every text."""
    return measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text"))


def failures(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> dict[str, Column]:
    """Whether a measured text fails each rule. The first two are the base rules."""
    return {
        "few_words": F.col("n_words") < min_words,
        "repeats": 100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "same_lines": F.col("n_dup_lines") >= MANY_DUP_LINES,
        "odd_words": (F.col("word_chars") < MEAN_WORD[0] * F.col("n_words")) | (F.col("word_chars") > MEAN_WORD[1] * F.col("n_words")),
    }


def judged(rows: DataFrame, min_words: int, max_repeat: int) -> DataFrame:
    """Measured rows with a boolean column for each rule, and base_failed."""
    return rows.withColumns(failures(min_words, max_repeat)).withColumn("base_failed", F.col("few_words") | F.col("repeats"))


def host_verdicts(table: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """One row per host: n_docs, host_rate (of the base rules, shrunk), host_failed, and strict_<rule> for each soft rule.

    A rule's prior is Beta(m s, (1 - m) s): m is the mean of the hosts' rates, and s comes from their variance v as
    m (1 - m) / v - 1, held within 1 and 1000. A single host, or hosts that all agree, get s = 1000 of their mean.
    """
    names = (*RULES, "base_failed")
    hosts = table.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(r).alias(r) for r in names])
    share = {r: F.col(r) / F.col("n_docs") for r in names}
    prior = hosts.agg(*[f(share[r]).alias(f"{r}_{x}") for r in names for x, f in (("m", F.avg), ("v", F.var_pop))])
    # The prior is one row, so this is a lookup and not a product of two tables.
    both = hosts.join(F.broadcast(prior), F.lit(True))

    def rate(r: str) -> Column:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        s = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
        return (F.col(r) + m * s) / (F.col("n_docs") + s)

    rejected = F.greatest(*[rate(r) for r in names]) > most_failed
    return both.select("host", "n_docs", rate("base_failed").alias("host_rate"), rejected.alias("host_failed"), *[(rate(r) >= F.col(f"{r}_m") - 1e-9).alias(f"strict_{r}") for r in SOFT])


def _kept() -> Column:
    """The verdict on a judged row that is joined to its host's verdicts."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = F.col("base_failed") | no("host_failed")
    for r in SOFT:
        bad = bad | (F.col(r) & no(f"strict_{r}"))
    return ~bad


def judge(spark: SparkSession, docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, most_failed: float = MOST_FAILED) -> DataFrame:
    """doc_id, the measures, base_failed, host_rate, host_failed and kept of every row."""
    scratch = Scratch(spark, "quality")
    table = scratch.cut(judged(measure(docs, host), min_words, max_repeat), "measures")
    # Written, the verdicts have a known size: Spark broadcasts them below its own threshold, and else splits hot hosts.
    verdicts = scratch.cut(host_verdicts(table, most_failed), "verdicts")
    return table.join(verdicts, "host", "left").select("doc_id", *MEASURES, "base_failed", "host_rate", F.coalesce("host_failed", F.lit(False)).alias("host_failed"), _kept().alias("kept"))


def keep(spark: SparkSession, docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, most_failed: float = MOST_FAILED) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are.

    Rows are measured once and written with their failures, without their columns where the base rules reject them;
    the host's verdicts are joined by host, so repeated ids stay apart.
    """
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.struct("*").alias("row"), F.col(host).cast("string").alias("host"), "text")
    flagged = judged(measured(rows), min_words, max_repeat).select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", *RULES, "base_failed")
    table = scratch.cut(flagged, "flagged")
    verdicts = scratch.cut(host_verdicts(table, most_failed), "verdicts")
    return table.where("not base_failed").join(verdicts, "host", "left").where(_kept()).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents."""
    return judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate", "host_failed")


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM rep GROUP BY r),
m AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  [n_words < {MIN_WORDS}, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words, 100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words, n_dup_lines >= {MANY_DUP_LINES},
   word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words] AS fails FROM m),
l AS (SELECT host, rule, count(*) AS n, count(*) FILTER (fails[rule]) AS f FROM b, range(1, 7) AS t(rule) WHERE host IS NOT NULL GROUP BY host, rule),
p AS (SELECT rule, avg(f / n) AS m, CASE WHEN var_pop(f / n) > 0 THEN least(greatest(avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM l GROUP BY rule),
v AS (SELECT host, rule, (f + m * s) / (n + s) AS rate, m FROM l JOIN p USING (rule)),
h AS (SELECT host, max(rate) > {MOST_FAILED} AS rejected, list(rule) FILTER (rule IN (3, 4, 5) AND rate >= m - 1e-9) AS strict FROM v GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(rejected, false) OR len(list_filter(coalesce(strict, []), lambda x: fails[x])) > 0) AS kept
FROM b LEFT JOIN h USING (host)
"""
