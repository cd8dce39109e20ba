"""Near-duplicate classes by b-bit MinHash with exact confirmation.

Texts with equal word sequences form a node first. Each node gets `bands * rows` minima; bands choose candidates
and the low `bits` bits of all minima, packed, estimate the similarity of a candidate pair from bit counts,
corrected for chance collisions. Pairs whose estimate lies more than `margin` below the threshold are let go
(six standard errors); the rest are confirmed on the full shingle sets, and there words are compared and not hashes.

No bucket is expanded into all its pairs. First each bucket's members are compared with its hub, the member with
the most company over all its bands, and the confirmed links are joined into components. Only buckets that still
hold several components go on: there, members outside the hub's component are compared with all others, in
blocks of at most `block` by `block` sets of 32-bit shingle hashes. Intersections are counted there by matrix products, and
only pairs across components leave a block that are linked, or would be but for colliding hashes; so groups of texts
that resemble one another without being linked do not leave it as pairs. A block holds fewer sets where they are
large: a bucket is cut so that no block is expected to hold more than `BLOCK_SHINGLES` shingles.

Defined cases: null text counts as empty; a text without words has an empty set and is linked with nothing; a
text with fewer words than a shingle has one shingle, its whole sequence; a null doc_id takes part but never
names a component that has another id; rows that repeat an id are rows of their own; an empty table gives an
empty result; other columns are ignored by `classes` and kept by `keep`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import wordhash
from skarn.llm.components import components
from skarn.llm.scratch import Scratch, released

BANDS, ROWS, BITS, MARGIN, BLOCK, BLOCK_SHINGLES, COLUMNS = 32, 4, 4, 0.19, 512, 1 << 20, 2048
_HASHES = BANDS * ROWS
_SEED = np.random.default_rng(20240229)
_MUL = (_SEED.integers(0, 1 << 31, _HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _SEED.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_LAST = 2**63 - 1


def shingle_runs(words: wordhash.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive texts, and where each text's begin; repeats are still in."""
    n = np.diff(words.first)
    every = wordhash.runs(words.hash, k)
    inside = np.ones(len(every), dtype=bool)
    for j in range(1, k):  # windows that would run into the next text
        at = words.first[1:-1] - j
        inside[at[(at >= 0) & (at < len(every))]] = False
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    short = np.flatnonzero((n > 0) & (n < k))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(first[-1], dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[first[short]] = False
    # a window starting in a short text always crosses its end, so it is not inside
    out[place] = every[inside]
    out[first[short]] = wordhash.span_hash(words.hash, words.first[short], words.first[short + 1]) if len(short) else out[:0]
    return out, first


def shingle_sets(column: pa.Array, k: int, key: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for row, to, words in wordhash.words_of(column, lower=True, key=key):
        shingles, first = shingle_runs(words, k)
        out += [np.unique(shingles[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def minima(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minima of each text that has shingles, one row of 32-bit values a text."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, _HASHES), dtype=np.uint32)
    if len(some):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        at = first[:-1][some]
        for j in range(_HASHES):
            out[some, j] = np.minimum.reduceat((x * _MUL[j]) ^ _XOR[j], at)
    return out


def pack_bits(values: np.ndarray) -> np.ndarray:
    """Four low bits of each value, two to a byte."""
    low = (values & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures, given as rows of 64-bit words that broadcast."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / (x.shape[-1] * 64 // BITS) - chance) / (1 - chance)


def _sign(k: int, key: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("words_id", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, words in wordhash.words_of(batch.column(2), lower=True, key=key):
                shingles, first = shingle_runs(words, k)
                values = minima(shingles, first)
                keys = np.zeros((len(values), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = wordhash.mix(keys * np.uint64(31) + values[:, r::ROWS] + np.uint64(1))
                keys = wordhash.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                packed = pack_bits(values)
                sizes = [len(np.unique(shingles[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                some = np.array(sizes) > 0
                raw = words.data.tobytes()
                ends = np.append(words.start, len(raw))
                same = [hashlib.blake2b(wordhash.joined(raw[ends[a] : words.end[b - 1]]), digest_size=16).digest() if b > a else None for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                bounds = pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, to - row),
                        batch.column(1).slice(row, to - row),
                        pa.array(sizes, pa.int64()),
                        pa.array(same, pa.binary()),
                        pa.array([p.tobytes() if ok else None for p, ok in zip(packed, some.tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(bounds, pa.array(keys[some].ravel())),
                    ],
                    schema=schema,
                )

    return run


def _short_sets(k: int, key: int):
    """(node, text) as (node, size of its set, 32-bit halves of its shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), k, key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets], pa.binary())], names=["node", "size", "shingles"])

    return run


_SIGNED = "doc_id long, text_key long, n_shingles long, words_id binary, signature binary, bands array<long>"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rows(column: pa.Array) -> np.ndarray:
    data, bounds = wordhash.buffers(column)
    return np.frombuffer(data.tobytes(), dtype="<u8").reshape(len(bounds) - 1, -1)


def _passing(least: float):
    """Pairs (a, b, signature_a, signature_b) whose estimate is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = similarity(_rows(batch.column(2)), _rows(batch.column(3))) >= least
                yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=_PAIRS).filter(pa.array(ok))

    return run


def common(bounds: np.ndarray, tokens: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets `rows` with sets `columns`; set i is tokens[bounds[i]:bounds[i + 1]]."""
    _, ids, uses = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = uses[ids] > 1
    number = np.cumsum(uses > 1) - 1
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[shared]
    ids = number[ids][shared]
    order = np.argsort(ids, kind="stable")
    of, ids = of[order], ids[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    places = []
    for part in (rows, columns):
        place = np.full(len(bounds) - 1, -1)
        place[part] = np.arange(len(part))
        places.append(place)
    for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        a, b = np.searchsorted(ids, [start, start + COLUMNS])
        sides = []
        for part, place in zip((rows, columns), places, strict=True):
            has = np.zeros((len(part), COLUMNS), dtype=np.float32)
            at = place[of[a:b]]
            has[at[at >= 0], (ids[a:b] - start)[at >= 0]] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _across(part: int, whole: int):
    """Within one block: pairs of a minor member and a member at home here, of different components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, component, size = (np.asarray(table[c]) for c in ("node", "component", "size"))
        minor, home = (np.flatnonzero(np.asarray(table[c])) for c in ("as_minor", "as_home"))
        if not len(minor) or not len(home):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        data, bounds = wordhash.buffers(table["shingles"].chunk(0))
        both = common(bounds // 4, np.frombuffer(data.tobytes(), dtype="<u4"), minor, home)
        total = size[minor][:, None] + size[home][None, :]
        both += 2 + (total * total >> 31)  # what collisions among 32-bit halves can hide
        ok = (whole * both >= part * (total - both)) & (component[minor][:, None] != component[home][None, :])
        i, j = np.nonzero(ok)
        x, y = node[minor[i]], node[home[j]]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return run


def _confirmed(k: int, part: int, whole: int):
    """Pairs (a, b, text_a, text_b) with whole * intersection >= part * union, on full sets of words."""

    def words(text: str | None) -> list[bytes]:
        return wordhash.lowered(np.frombuffer((text or "").encode(), dtype=np.uint8)).tobytes().split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, []
        for batch in batches:
            for row, to in wordhash.chunks(wordhash.buffers(batch.column(3))[1]):
                piece = batch.slice(row, to - row)
                a, texts, at = piece.column(0).to_pylist(), [hub], []
                for i, own in enumerate(a):  # rows of one hub mostly stand together
                    if own != last:
                        texts.append(words(piece.column(2)[i].as_py()))
                        last, hub = own, texts[-1]
                    at.append(len(texts) - 1)
                sets = wordhash.named(texts + [words(t) for t in piece.column(3).to_pylist()], k)
                ok = []
                for mine, yours in zip((sets[i] for i in at), sets[len(texts) :], strict=True):
                    both = len(np.intersect1d(mine, yours, assume_unique=True))
                    ok.append(whole * both >= part * (len(mine) + len(yours) - both))
                yield pa.RecordBatch.from_arrays(piece.columns[:2], schema=_PAIRS).filter(pa.array(ok, pa.bool_()))

    return run


def classes(spark: SparkSession, docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept and is_first for every row.

    Rows are linked when whole * |intersection| >= part * |union| of their sets of k-word shingles. component_id
    is the smallest doc_id in the component. is_first marks one row a component even where ids repeat.
    """
    scratch = Scratch(spark, "neardup")
    least, key = part / whole - margin, wordhash.new_key()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("text").cast("string").alias("text"))
    signed = scratch.cut(keyed.mapInArrow(_sign(k, key), _SIGNED), "signed")

    # A node for each distinct sequence of words: copies meet here, before shuffling, and go no further.
    sets = signed.where("words_id is not null").groupBy("words_id").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text_key")).alias("of"), F.min("doc_id").alias("least_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    nodes = scratch.cut(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    # Written before they are joined, like all groups here: the join then lies right on its exchanges, where hot keys can be split.
    shared = scratch.cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    member = scratch.cut(banded.join(shared, "bucket"), "members")
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = scratch.cut(member.join(company, "node"), "ranked")
    hubs = scratch.cut(ranked.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("hub")), "hubs")
    stars = ranked.join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    signature = nodes.select("node", "signature")

    def estimated(pairs: DataFrame) -> DataFrame:
        one = pairs.join(signature.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        two = one.join(signature.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
        return two.select("a", "b", "sa", "sb").mapInArrow(_passing(least), "a long, b long")

    def texts(need: DataFrame, name: str) -> DataFrame:
        of = nodes.join(need, "node").select("node", F.col("of.doc_id").alias("id"), F.col("of.text_key").alias("key"))
        found = keyed.join(of, (F.coalesce(keyed["doc_id"], F.lit(_LAST)) == of["id"]) & (keyed["text_key"] == of["key"]))
        return scratch.cut(found.dropDuplicates(["node"]).select("node", "text"), f"{name}-texts")

    def confirmed(pairs: DataFrame, text: DataFrame, name: str) -> DataFrame:
        one = pairs.join(text.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        two = one.join(text.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return scratch.cut(two.select("a", "b", "ta", "tb").mapInArrow(_confirmed(k, part, whole), "a long, b long"), f"{name}-links")

    pairs = scratch.cut(estimated(stars), "stars")
    links = confirmed(pairs, texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "stars"), "stars")
    label = components(scratch, links, "first")

    # Buckets in which several components are left, other than pairs: their hub has met every member.
    placed = ranked.where("n > 2").join(label, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    hub_at = hubs.join(label.withColumnRenamed("node", "hub"), "hub", "left").select("bucket", "hub", F.coalesce("component", "hub").alias("hub_component"))
    placed = scratch.cut(placed.join(hub_at, "bucket").where("node <> hub").withColumn("minor", F.col("component") != F.col("hub_component")), "placed")
    left = scratch.cut(placed.groupBy("bucket").agg(F.count_if("minor").alias("n_minor")).where("n_minor > 0"), "left")
    still = scratch.cut(placed.join(left, "bucket"), "open")
    open_texts = texts(still.select("node").distinct(), "open")
    short_sets = scratch.cut(open_texts.mapInArrow(_short_sets(k, key), "node long, size long, shingles binary"), "sets")
    rows = scratch.cut(still.join(short_sets.select("node", "size"), "node"), "sized")
    sums = scratch.cut(rows.groupBy("bucket").agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("minor"), F.col("size"))).alias("minor_size")), "sums")
    cuts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(2 * size / BLOCK_SHINGLES)).cast("int")
    blocks, minor_blocks = cuts(F.col("n"), F.col("all_size")), cuts(F.col("n_minor"), F.col("minor_size"))
    spot = F.xxhash64("node")
    open_rows = rows.join(sums, "bucket").select("bucket", "node", "component", "size", "minor", blocks.alias("blocks"), minor_blocks.alias("minor_blocks")).join(short_sets.select("node", "shingles"), "node")
    at_home = open_rows.select("bucket", "node", "component", "size", "shingles", F.lit(True).alias("as_home"), F.lit(False).alias("as_minor"), F.pmod(spot, "blocks").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("i"))
    as_minor = open_rows.where("minor").select("bucket", "node", "component", "size", "shingles", F.lit(False).alias("as_home"), F.lit(True).alias("as_minor"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.pmod(spot, "minor_blocks").cast("int").alias("i"))
    more = scratch.cut(at_home.unionByName(as_minor).groupBy("bucket", "i", "j").applyInArrow(_across(part, whole), "a long, b long").distinct(), "more")
    more_links = confirmed(more, open_texts, "more")
    comp = label
    if not more_links.isEmpty():
        comp = components(scratch, links.union(more_links), "second")

    placed_nodes = nodes.join(comp, "node", "left").select("words_id", "least_id", F.col("of.doc_id").alias("of_id"), F.col("of.text_key").alias("of_key"), F.coalesce("component", "node").alias("component"))
    placed_nodes = scratch.cut(placed_nodes, "components")
    named = scratch.cut(placed_nodes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min(F.struct("of_id", "of_key")).alias("lead")), "named")
    by_words = scratch.cut(placed_nodes.join(named, "component").select("words_id", "component_id", "lead"), "by-words")
    scratch.drop("nodes", "shared", "members", "ranked", "hubs", "stars", "stars-texts", "stars-links", "placed", "left", "open", "open-texts", "sets", "sized", "sums", "more", "more-links", "components", "named")
    out = signed.select("doc_id", "text_key", "n_shingles", "words_id").join(by_words, "words_id", "left")
    component_id = F.when(F.col("words_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    first = F.col("words_id").isNull() | ((F.coalesce("doc_id", F.lit(_LAST)) == F.col("lead.of_id")) & (F.col("text_key") == F.col("lead.of_key")))
    return out.select("doc_id", "text_key", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), first.alias("is_first"))


def keep(spark: SparkSession, docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of docs. Of rows that repeat it, all stay."""
    with released():
        gone = classes(spark, docs, k, part, whole).where("not is_first").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
        own = Scratch.apart(spark, "neardup-keep")
        gone = own.cut(gone, "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti").select("row.*")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: three-word shingles, similarity of 85 % or more."""
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, part=85, whole=100).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) AS m ON m.id = d.doc_id
"""
