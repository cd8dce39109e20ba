"""Substring deduplication on a compacted De Bruijn graph of word k-mers.

Of the k-mers of a 50-word window the one with the smallest hash is the window's anchor; equal windows have equal
anchors at equal places. The graph holds these least k-mers and not all: consecutive windows with one anchor form an
edge, kept as one row with its source coordinates (about thirteen windows a row on the check tables). Edges that occur in several
documents are compacted through Spark joins: steps between neighbouring edges that never branch make paths, and
each path becomes one span (`compacted`). Where an anchor has several edges, each of them once is left to be compared
window by window.

Verification goes back to the source coordinates: the words at every span, and of every such window, are read from
the texts and compared by a 128-bit cryptographic digest. Only spans whose words also lie in a document with a smaller
id are removed, so no result rests on the hashes that built the graph. Nothing is expanded into pairs.

Defined cases: null text counts as empty; a text of fewer words than a window loses nothing; a window repeated
within one document, or in rows of the same doc_id, removes nothing; a null doc_id neither loses words nor is
a source; rows that repeat an id are judged one by one; an empty table gives an empty result; other columns are
ignored by `removals` and kept by `clean`, whatever their names; `clean` also updates n_chars where there is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.llm import wordhash
from skarn.llm.scratch import Scratch, released

WINDOW, ANCHOR = 50, 16
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("anchor", pa.int64()), ("edge", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
_FOUND_SQL = "doc_id long, text_key long, n_words long, kept_sha256 string, anchor long, edge long, s int, e int"
_LOOKED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary()), ("s", pa.int32()), ("e", pa.int32())])
_CLEANED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each window of `width` values, by doubling."""
    best = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        have += step
    return best


def edges(words: wordhash.Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, edge hash, first window start, last window start) of each edge; starts count from the buffer's first word."""
    h, first = words.hash, words.first
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    mers = wordhash.runs(h, k)
    at = least_at(mers, window - k + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(text[:n] == text[window - 1 :])
    at = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1])
    begin = np.flatnonzero(new)
    s, e = start[begin], start[np.append(begin[1:], len(start)) - 1] if len(begin) else begin
    return text[s], mers[at[begin]], wordhash.span_hash(h, s, e + window), s, e


def _find(window: int, k: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, words in wordhash.words_of(batch.column(2), lower=False, key=key):
                ids, keys = batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row)
                raw = words.data.tobytes()
                first = words.first
                sha = []
                ends = np.append(words.start, len(raw))
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    sha.append(hashlib.sha256(wordhash.joined(raw[ends[a] : words.end[b - 1]]) if b > a else b"").hexdigest())
                none = pa.nulls(to - row, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(np.diff(first), pa.int64()), pa.array(sha), none, none, pa.nulls(to - row, pa.int32()), pa.nulls(to - row, pa.int32())], schema=_FOUND)
                text, anchor, edge, s, e = edges(words, window, k)
                if len(text):
                    of = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(of), keys.take(of), pa.nulls(len(text), pa.int64()), pa.nulls(len(text), pa.string()), pa.array(anchor.view(np.int64)), pa.array(edge.view(np.int64)), pa.array((s - first[text]).astype(np.int32)), pa.array((e - first[text]).astype(np.int32))],
                        schema=_FOUND,
                    )

    return run


def _look(window: int):
    """Digests of the words that lie at `spans` of each text: of each window apart where `apart`, else of the whole span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, digests, start, end = [], [], [], []
            for r, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = (text or "").encode().split()
                raw = b" ".join(words)
                at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
                for c in spans:
                    for s, e in [(i, i) for i in range(c["s"], c["e"] + 1)] if c["apart"] else [(c["s"], c["e"])]:
                        digests.append(hashlib.blake2b(raw[at[s] : at[e + window] - 1], digest_size=16).digest())
                        which.append(r)
                        start.append(s)
                        end.append(e)
                if len(which) >= 50_000 or r == batch.num_rows - 1:
                    of = pa.array(which, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(digests, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=_LOOKED)
                    which, digests, start, end = [], [], [], []

    return run


def _remove(window: int):
    """Texts without the words that `spans` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3).to_pylist()
            out = []
            for row, to, words in wordhash.words_of(batch.column(2), lower=False, key=None):
                raw = words.data.tobytes()
                for r in range(row, to):
                    a, b = int(words.first[r - row]), int(words.first[r - row + 1])
                    depth = np.zeros(b - a + 1, dtype=np.int64)
                    for s in spans[r]:
                        depth[s["s"]] += 1
                        depth[s["e"] + window] -= 1
                    gone = np.cumsum(depth[:-1]) > 0
                    start, end = words.start[a:b], words.end[a:b]
                    left = np.flatnonzero(~gone)
                    kept = b" ".join([raw[x:y] for x, y in zip(start[left].tolist(), end[left].tolist(), strict=True)])
                    # The text keeps its own white space; a removed run takes what follows its words with it.
                    edge = np.append(start[1:], end[-1:]) if b > a else start
                    text = b"".join([raw[x:y] for x, y in zip(start[left].tolist(), edge[left].tolist(), strict=True)]).rstrip()
                    out.append((len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), text.decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[j] for x in out], type=_CLEANED.field(j + 2).type) for j in range(4)]], schema=_CLEANED)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def compacted(scratch: Scratch, occurrences: DataFrame) -> DataFrame:
    """occurrences (doc_id, text_key, edge, s, e) as edge, head, length for each edge: nonbranching paths by their first edge.

    An edge goes on to another if each of its occurrences is followed at once by that one, and that one is never
    entered from elsewhere. Paths are the chains of such steps; each edge finds its head by pointer jumping, so a
    path of n edges takes about log2(n) joins of distinct edges. length is the number of windows of the whole path.
    """
    line = Window.partitionBy("doc_id", "text_key").orderBy("s")
    around = occurrences.select("edge", "s", "e", F.lead(F.struct("s", "edge")).over(line).alias("next"), F.lag(F.struct("e", "edge")).over(line).alias("back"))
    after, before = F.when(F.col("next.s") == F.col("e") + 1, F.col("next.edge")), F.when(F.col("back.e") == F.col("s") - 1, F.col("back.edge"))
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    steps = around.select("edge", (F.col("e") - F.col("s") + 1).alias("n"), after.alias("after"), before.alias("before"))
    degree = scratch.cut(steps.groupBy("edge").agg(F.max("n").cast("long").alias("n"), one("after").alias("out"), one("before").alias("into")), "degrees")
    went = degree.where("out is not null").select(F.col("edge").alias("from"), F.col("out").alias("to"))
    up = degree.join(went, (degree["edge"] == went["to"]) & (degree["into"] == went["from"]), "left").select("edge", "n", F.coalesce("from", "edge").alias("head"))
    up, step = scratch.cut(up, "path-0"), 0
    while True:
        above = up.select(F.col("edge").alias("head"), F.col("head").alias("higher"))
        up, old, step = scratch.cut(up.join(above, "head").select("edge", "n", F.col("higher").alias("head"), (F.col("higher") != F.col("head")).alias("moved")), f"path-{step + 1}"), f"path-{step}", step + 1
        scratch.drop(old)
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return scratch.cut(up.groupBy("head").agg(F.sum("n").alias("length")), "paths")


def _cleaned(spark: SparkSession, docs: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(all documents as they came: ids, n_words, sha; those that lose words: new values and text)."""
    scratch = Scratch(spark, "substring")
    found = scratch.cut(_keyed(docs).mapInArrow(_find(window, k, wordhash.new_key()), _FOUND_SQL), "found")
    edge = found.where("anchor is not null and doc_id is not null").select("doc_id", "text_key", "anchor", "edge", "s", "e")

    seen = edge.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("edge") == F.max("edge")).alias("straight"))
    # Written before they are joined: the join then lies right on its two exchanges, where a hot anchor can be split.
    anchors = scratch.cut(seen.where("low < high").select("anchor", "straight"), "anchors")
    at = scratch.cut(edge.join(anchors, "anchor"), "repeated")
    by_edge = scratch.cut(at.groupBy("edge").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "edges")
    met = scratch.cut(at.join(by_edge, "edge"), "met")
    occurrences = met.where("low < high").select("doc_id", "text_key", "edge", "s", "e")
    paths = compacted(scratch, occurrences)
    spans = occurrences.join(paths, F.col("edge") == F.col("head")).select("doc_id", "text_key", "s", (F.col("s") + F.col("length") - 1).cast("int").alias("e"), F.lit(False).alias("apart"))
    branching = met.where("not straight and doc_id = low").select("doc_id", "text_key", "s", "e", F.lit(True).alias("apart"))

    # Spans by document: as many as its own text has, so a group is no larger than a row that exists anyway.
    by_doc = scratch.cut(spans.unionByName(branching).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e", "apart")).alias("spans")), "spans")
    texts = scratch.cut(_keyed(docs).join(by_doc, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans"), "texts")
    scratch.drop("anchors", "repeated", "edges", "met", "degrees", "paths", "spans")
    looked = scratch.cut(texts.mapInArrow(_look(window), "doc_id long, text_key long, digest binary, s int, e int"), "looked")
    low = scratch.cut(looked.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "lows")
    gone = looked.join(low, "digest").where("doc_id > low").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    ready = texts.drop("spans").join(gone, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    cleaned = scratch.cut(ready.mapInArrow(_remove(window), "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, text string"), "cleaned")
    scratch.drop("texts", "looked", "lows")
    return found.where("n_words is not null").select("doc_id", "text_key", "n_words", "kept_sha256"), cleaned


def removals(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row."""
    every, cleaned = _cleaned(spark, docs, window, k)
    new = cleaned.select("doc_id", "text_key", "n_removed", F.col("kept_sha256").alias("sha"))
    return every.join(new, ["doc_id", "text_key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


def clean(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """docs with the repeated words taken out of their texts; every row stays, even one left empty."""
    with released():
        _, cleaned = _cleaned(spark, docs, window, k)
        new = Scratch.apart(spark, "substring-new").cut(cleaned.select(F.col("doc_id").alias("new_id"), F.col("text_key").alias("new_key"), F.col("text").alias("new_text")), "new")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    joined = rows.join(new, (F.col("id") == F.col("new_id")) & (F.col("key") == F.col("new_key")), "left")
    own = lambda c: F.col("row").getField(c)
    value = {"text": F.coalesce("new_text", own("text"))}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("new_text").isNull(), own("n_chars")).otherwise(F.length("new_text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[value.get(c, own(c)).alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows, removed from all documents but the first."""
    return removals(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
c AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM w) WHERE low < doc_id),
p AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM c),
k AS (SELECT r, list(i) AS gone FROM p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
