"""Answers and runs of an evaluation: schemas, verdicts, citations, usage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.windows import running

ANSWER = "answer_type string, claims array<struct<text:string, evidence_ids:array<string>, quotes:array<struct<evidence_id:string, quote:string>>>>"
KINDS = ("grounded", "abstain", "clarification", "conversation")
MOST_CLAIMS, MOST_CHARS = 12, 3000


def schema_problem(answer: Column) -> Column:
    """Why an answer in JSON breaks its schema, or null."""
    x = F.from_json(answer, ANSWER)
    claims = F.coalesce(x["claims"], F.array().cast("array<struct<text:string,evidence_ids:array<string>,quotes:array<struct<evidence_id:string,quote:string>>>>"))
    whole = F.forall(claims, lambda c: c["text"].isNotNull() & F.coalesce(F.length(c["text"]) <= MOST_CHARS, F.lit(False)) & (F.coalesce(F.size(c["evidence_ids"]), F.lit(0)) > 0) & F.forall(F.coalesce(c["quotes"], F.array().cast("array<struct<evidence_id:string,quote:string>>")), lambda q: q["evidence_id"].isNotNull() & q["quote"].isNotNull()))
    return (
        F.when(x.isNull() | x["answer_type"].isNull(), "not an answer")
        .when(~x["answer_type"].isin(*KINDS), "unknown type")
        .when((x["answer_type"] == "grounded") & ~F.size(claims).between(1, MOST_CLAIMS), "number of claims")
        .when(~whole, "incomplete claim")
    )


def verdicts(claims: DataFrame, given: DataFrame) -> DataFrame:
    """answer, supported of claims (answer, claim_index): every claim has just one verdict, nothing else has, and all are true."""
    ok = F.coalesce(F.col("supported") & F.col("qualifications_complete") & F.col("relevant"), F.lit(False))
    one = given.groupBy("answer", "claim_index").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("ok"))
    both = claims.select("answer", "claim_index", F.lit(True).alias("asked")).join(one, ["answer", "claim_index"], "full")
    return both.groupBy("answer").agg(F.bool_and(F.col("asked").isNotNull() & F.coalesce((F.col("n") == 1) & F.col("ok"), F.lit(False))).alias("supported"))


def checked(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (case, text, expected) with n_cited, n_unknown, n_malformed and valid; evidence is (case, evidence_id, section)."""
    cited = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(E\d+)\]"), 1))
    malformed = F.size(F.regexp_extract_all("text", F.lit(r"\[(?!E\d+\])[^\]]*\]"), 0))
    known = evidence.groupBy("case").agg(F.collect_set("evidence_id").alias("known"), F.collect_set(F.struct("evidence_id", "section")).alias("of"))
    both = answers.select("case", "expected", cited.alias("cited"), malformed.alias("malformed")).join(known, "case", "left")
    unknown = F.array_except("cited", F.coalesce("known", F.array().cast("array<string>")))
    hit = F.exists(F.coalesce("of", F.array().cast("array<struct<evidence_id:string,section:string>>")), lambda e: F.array_contains("cited", e["evidence_id"]) & (e["section"] == F.col("expected")))
    return both.select("case", F.size("cited").alias("n_cited"), F.size(unknown).alias("n_unknown"), F.col("malformed").alias("n_malformed"), ((F.size("cited") > 0) & (F.size(unknown) == 0) & (F.col("malformed") == 0) & hit).alias("valid"))


def compacted(passages: DataFrame) -> DataFrame:
    """passages (question, turn, ord, section, page, text): the first of each (section, page) of a turn, 'new' or 'existing' by earlier turns."""
    first = Window.partitionBy("question", "turn", "section", "page").orderBy("ord")
    kept = passages.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    earliest = F.min("turn").over(Window.partitionBy("question", "section", "page"))
    return kept.withColumn("state", F.when(F.col("turn") == earliest, "new").otherwise("existing"))


def usage(calls: DataFrame, grains: list[str], order: str, tokens: str) -> DataFrame:
    """calls with the running sum of tokens over each grain: within all grains, within all but the last, and so on."""
    out = calls
    for n in range(len(grains), 0, -1):
        out = running(out, grains[:n], [order], F.col(tokens), f"{tokens}_by_{grains[n - 1]}")
    return out


def payload(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """key, part, n_bytes, n_tokens (a quarter of the characters, rounded up, one at least) of each part of a payload."""
    one = lambda c: F.struct(F.lit(c).alias("part"), F.octet_length(F.coalesce(c, F.lit(""))).alias("n_bytes"), F.greatest(F.lit(1), F.floor((F.length(F.coalesce(c, F.lit(""))) + 3) / 4).cast("int")).alias("n_tokens"))
    return rows.select(key, F.inline(F.array(*[one(c) for c in parts])))


def gate(cases: DataFrame, most_tokens: int) -> DataFrame:
    """One row: n_cases, n_covered, n_tokens, passed of cases (expected: sections, found: sections, n_tokens)."""
    covered = F.size(F.array_except("expected", "found")) == 0
    out = cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(covered).alias("n_covered"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    return out.withColumn("passed", (F.col("n_cases") == F.col("n_covered")) & (F.col("n_tokens") <= most_tokens))


def corrected(cases: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """cases with the corrected values of a column; a correction must name just one case, or the query fails."""
    n = cases.join(corrections.select(key), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    asked = corrections.join(n, key, "left")
    sure = asked.select(key, F.when(F.coalesce("n", F.lit(0)) == 1, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("not just one case: "), F.col(key).cast("string")))).alias("__new"), F.lit(True).alias("__has"))
    return cases.join(sure, key, "left").withColumn(column, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__has")
