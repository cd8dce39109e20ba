"""Rankings of passages and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import coverage as C
from skarn.functions.text import collapse, let, ngrams, tokens
from skarn.sources.shipping import ship, small_batches


def lexical(passages: DataFrame, query: str, owner: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """Owners by phrase score: 1 for each distinct term, 5 for each pair, 10 for each triple that a passage contains.

    Terms have more than two characters and match as substrings; an owner has the score of its best passage. The
    query's phrases are literals, so one pass over the passages does it, and only k rows meet at the end.
    """
    words = [w for w in _words(query) if len(w) > 2]
    grams = lambda n: list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
    body = collapse(F.lower(F.col(text)))
    phrases = [(g, weight) for n, weight in ((1, 1), (2, 5), (3, 10)) for g in grams(n)]
    if not phrases:
        return passages.select(owner, F.lit(0).alias("score")).limit(0)
    score = let(body, lambda b: reduce(Column.__add__, [F.when(F.contains(b, F.lit(g)), weight).otherwise(0) for g, weight in phrases]))
    scored = passages.select(owner, score.alias("score")).where("score > 0")
    return scored.groupBy(owner).agg(F.max("score").alias("score")).orderBy(F.desc("score"), owner).limit(k)


def _words(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def inverted_index(passages: DataFrame, owner: str = "doc_id", text: str = "text") -> DataFrame:
    """term, owner, tf, length: write this once; queries then read only their own terms."""
    words = passages.select(owner, tokens(F.col(text)).alias("words"))
    return words.select(owner, F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", owner).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def term_totals(passages: DataFrame, owner: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df, cf: the owners that have a term, and its uses; passages without owner count in cf only.

    A row whose owner has no other is counted within its task, so sums of terms are shuffled and not postings. Rows of
    owners with several meet by term and owner.
    """
    ship(passages.sparkSession)
    small_batches(passages.sparkSession)
    alone = passages.select(owner, text)
    repeated = alone.groupBy(owner).count().where(f"count > 1 and `{owner}` is not null").select(owner)
    several = None
    if not repeated.isEmpty():
        several = inverted_index(alone.join(repeated, owner, "left_semi"), owner, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        alone = alone.join(repeated, owner, "left_anti")
    totals = alone.select(F.col(owner).isNotNull().alias("owned"), F.col(text).alias("text")).mapInArrow(C.term_totals, "term string, df long, cf long")
    totals = totals if several is None else totals.unionByName(several)
    return totals.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bm25(passages: DataFrame, query: str, owner: str = "doc_id", text: str = "text", k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Owners by BM25. Counts are taken over all passages; only the query's terms leave the scan."""
    terms = sorted(set(_words(query)))
    words = passages.select(owner, tokens(F.col(text)).alias("words"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"))
    uses = lambda t: F.size(F.filter("words", lambda w: w == t))
    tf = words.select(owner, F.size("words").alias("length"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), uses(t).alias("tf")) for t in terms])).alias("x"))
    tf = tf.select(owner, "length", "x.term", "x.tf").where("tf > 0")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    both = tf.join(df, "term").join(F.broadcast(stats), F.lit(True))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return both.groupBy(owner).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), owner).limit(k)


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine(vectors: DataFrame, query: DataFrame, owner: str = "vec_id", k: int = 10) -> DataFrame:
    """Owners by cosine to the one vector of `query` (column q)."""
    scored = vectors.join(F.broadcast(query.select("q")), F.lit(True))
    return scored.select(owner, F.round(cosine_of(F.col("embedding"), F.col("q")), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), owner).limit(k)


def ranked(hits: DataFrame, owner: str, method: str) -> DataFrame:
    """Positions in one ranking, which has a bounded number of rows."""
    return hits.select(F.col(owner).alias("owner"), F.row_number().over(Window.partitionBy(F.lit(method)).orderBy(F.desc("score"), owner)).alias("rank"), F.lit(method).alias("method"))


def fuse(rankings: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (owner, rank, method): a repeat consumes its rank and counts once."""
    union = reduce(DataFrame.unionByName, rankings)
    first = union.groupBy("owner", "method").agg(F.min("rank").alias("rank"))
    score = F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 9)
    return first.groupBy("owner").agg(score.alias("fusion_score"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")).orderBy(F.desc("fusion_score"), F.col("owner").cast("string")).limit(k)


def concatenated(rankings: list[DataFrame], k: int = 5) -> DataFrame:
    """Rankings one behind the other, repeats dropped, the first k."""
    union = reduce(DataFrame.unionByName, [r.withColumn("leg", F.lit(i)) for i, r in enumerate(rankings)])
    first = union.groupBy("owner").agg(F.min(F.struct("leg", "rank")).alias("at"))
    return first.orderBy("at", "owner").limit(k).select("owner", F.col("at.leg").alias("leg"), F.col("at.rank").alias("rank"))


def phrase_table(passages: DataFrame, owner: str = "doc_id", text: str = "text", n: int = 2) -> DataFrame:
    """owner, phrase: n-grams of tokens, for phrase queries by equality."""
    return passages.select(owner, F.explode(ngrams(tokens(F.col(text)), n)).alias("phrase"))


def _nearest(v, q, k: int):
    import numpy as np
    import pandas as pd

    names = ["q", "ql", "vec_id", "label", "score"]
    if v.empty or q.empty:
        return pd.DataFrame(columns=names)
    a, b = (np.stack(x["embedding"]).astype("float64") for x in (v, q))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (b @ a.T) / (np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1))
    ids, out = v["vec_id"].to_numpy(), []
    for i, (own, label) in enumerate(zip(q["vec_id"], q["label"], strict=True)):
        score = np.round(np.where(np.isfinite(c[i]), c[i], -2.0), 6)
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != own][:k]
        out += [(own, label, ids[j], v["label"].iloc[j], score[j]) for j in best]
    return pd.DataFrame(out, columns=names)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """q, ql, vec_id, label, score: the k other vectors of the highest cosine of each query; both have vec_id, label, embedding.

    Blocks of queries meet blocks of vectors, and only the k best of a query leave a block, so rows grow with the blocks
    and not with the pairs. Scores have six digits; a vector without length comes last, with -2.
    """
    ship(vectors.sparkSession)
    within = lambda df, name: df.select("vec_id", "label", "embedding", F.floor(F.row_number().over(Window.partitionBy("part").orderBy("vec_id")) / block).alias("n"), "part").withColumn(name, F.struct("part", "n"))
    v = within(vectors.withColumn("part", F.expr(f"vec_id div {16 * block}")), "vb").drop("part", "n")
    q = within(queries.withColumn("part", F.expr(f"vec_id div {1600 * block}")), "qb").drop("part", "n")
    left, right = v.crossJoin(q.select("qb").distinct()), q.crossJoin(v.select("vb").distinct())
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come of one table
    met = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(lambda a, b: _nearest(a, b, k), "q long, ql long, vec_id long, label long, score double")
    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rn", top).where(F.col("rn") <= k).drop("rn")
