"""Training-text queries against their SQL, and without SQL against brute force or an exact round trip."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("skarn.llm")

from skarn.llm import neardup, packing, pieces, ranker, registry  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, same, small, name):
    same(registry.QUERIES[name](spark, small), registry.ORACLE[name], small)


def brute_components(texts: dict, k: int, part: int, whole: int) -> dict:
    """doc_id: (set size, smallest id reachable), by all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = defaultdict(int)
    for ids in where.values():
        for a in range(len(ids)):
            for b in ids[a + 1 :]:
                shared[ids[a], b] += 1
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if whole * n >= part * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = brute_components(texts, 3, 85, 100)
    got = registry.QUERIES["op3_minhash_near_dedup"](spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_crowd_of_near_misses_and_chains(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([2, 3, 6, 8, 9, 10, 12])):
            w[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = brute_components(dict(rows), 3, 85, 100)
    got = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100, block=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_packing_holds_every_id_once(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs}
    got = sorted((r.asDict() for r in registry.QUERIES["op7_packing"](spark, small).collect()), key=lambda r: (r["doc_id"], r["start"]))
    at = defaultdict(int)
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["length"] == len(ids) > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at[r["doc_id"]] += r["length"]
    assert dict(at) == {i: len(x) for i, x in want.items()}
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    padding = sum(4096 - n for n in fill.values() if n & (n - 1))
    assert max(fill.values()) <= 4096 and padding < 0.02 * sum(fill.values())


def test_pieces_equal_the_library(spark, small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    odd = ["", "  a  b\n\tc ﬁ ", "x" * 700, "ab" * 400 + " é", "😀 ▁▁a ▁ b", " ", "\n\n x", "the the\x00z", "日本語 テキスト"]
    own = pieces.codec(pieces.default_model())
    for text, ids in zip(odd, own.encode([x.encode() for x in odd]), strict=True):
        assert ids.tolist() == model.encode(text), text
        assert own.decode(ids).decode() == text.replace("▁", " ")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in registry.QUERIES["op6_sentencepiece"](spark, small).collect():
        ids = model.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_viterbi_finds_the_best_segmentation():
    import random

    import numpy as np

    rng = random.Random(1)
    voc = {w: i for i, w in enumerate(sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a", "b"}))}
    scores = {w: -rng.random() * 5 for w in voc}
    engine, names = pieces.Viterbi(voc, scores), {i: w for w, i in voc.items()}

    def best(w):
        found = [0.0]
        for end in range(1, len(w) + 1):
            found.append(max(found[s] + scores.get(w[s:end], engine.unknown if end - s == 1 else float("-inf")) for s in range(end)))
        return found[-1]

    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["abcd" * 100]
    flat, counts = engine.segment(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert "".join(names[i] if i in names else chr(i - pieces._UNKNOWN) for i in ids.tolist()) == w
        assert sum(scores[names[i]] if i in names else engine.unknown for i in ids.tolist()) == pytest.approx(best(w))


def test_joined_pieces_are_what_merging_gives():
    """A BPE vocabulary grown from random text: the search against merges done one by one."""
    import random

    import numpy as np

    rng = random.Random(4)
    corpus = [[*"".join(rng.choice("aabbc") for _ in range(rng.randint(1, 12)))] for _ in range(300)]
    scores = {c: 0.0 for c in "ab"}  # "c" is part of pieces, but none itself
    for rank in range(60):
        uses = defaultdict(int)
        for w in corpus:
            for x, y in zip(w, w[1:], strict=False):
                uses[x, y] += 1
        pair = max(uses, key=lambda p: (uses[p], p))
        if "".join(pair) in scores:
            break
        scores["".join(pair)] = -float(rank)
        corpus = [merged(w, pair) for w in corpus]
    voc = {p: i for i, p in enumerate(scores)}
    engine = pieces.Viterbi(voc, scores, bpe=True)
    back = {i: p for p, i in engine.symbol.items()}

    def by_merging(w):
        w = list(w)
        while True:
            ranked = [(-scores[x + y], i) for i, (x, y) in enumerate(zip(w, w[1:], strict=False)) if x + y in scores and len(x + y) > 1]
            if not ranked:
                return w
            i = min(ranked)[1]
            w[i : i + 2] = [w[i] + w[i + 1]]

    words = ["".join(rng.choice("aabbcd") for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["aab" * 120, "a" * 301]
    flat, counts = engine.segment(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert [back[i] if i in back else chr(i - pieces._UNKNOWN) for i in ids.tolist()] == by_merging(w), w


def merged(w, pair):
    out = []
    for x in w:
        if out and (out[-1], x) == pair:
            out[-1] += x
        else:
            out.append(x)
    return out


def test_ranker_learns_from_other_rows_only(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[x["doc_id"]]["score"], x["quality"]) for x in labels if x["doc_id"] in got and got[x["doc_id"]]["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, p in held if p == 1 for b, q in held if q == 0]
    assert sum(pairs) / len(pairs) > 0.9


def test_ranker_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in ranker.score(spark, docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert {r["score"] for r in ranker.score(spark, docs, one).collect()} == {1.0}


def plain_features(text: str) -> list[float]:
    """The ranker's features by plain Python, on bytes."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if not spans:
        return [0.0] * ranker.FEATURES
    body, ws = raw[spans[0][0] : spans[-1][1]], [raw[a:b] for a, b in spans]
    tail = raw[spans[0][0] :]
    n, lens, kinds = len(ws), [len(w) for w in ws], defaultdict(int)
    for w in ws:
        kinds[w] += 1
    grams = [tuple(ws[i : i + 3]) for i in range(n - 2)]
    lines = body.split(b"\n")
    mean = sum(lens) / n
    return [
        *[sum(tail.count(bytes([c])) for c in chars) / len(body) for chars in ranker._CLASSES],
        math.log1p(n), mean, max(sum(x * x for x in lens) / n - mean * mean, 0) ** 0.5, sum(x <= 3 for x in lens) / n, sum(x >= 12 for x in lens) / n,
        len(kinds) / n**0.5, max(kinds.values()) / n, 1 - len(set(grams)) / len(grams) if grams else 0, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)),
    ]


def plain_grams(text: str, bucket: dict) -> tuple[dict, dict]:
    """Counts by bucket of a text's words and pairs; bucket finds a word's or a pair's."""
    ws = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", lower(text).encode())]
    one, two = defaultdict(int), defaultdict(int)
    for w in ws:
        one[bucket(w)[0]] += 1
    for pair in zip(ws, ws[1:], strict=False):
        two[bucket(b" ".join(pair))[1]] += 1
    return one, two


def test_ranker_equals_a_plain_bradley_terry_fit(spark, small):
    """All documents scored by plain Python: features, folded log odds, gradient descent on the pairs, and a grid of slopes."""
    from functools import lru_cache

    import numpy as np
    import pyarrow as pa

    from skarn.llm import wordhash

    @lru_cache(maxsize=None)
    def bucket(gram):
        _, _, words = next(wordhash.words_of(pa.array([gram.decode()]), lower=True, key=ranker._KEY))
        one, two = ranker.gram_buckets(words)
        return int(one[0]), int(two[0]) if len(two) else None

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    train = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    assert len(train) < ranker.MOST_ROWS
    own, grams = {i: plain_features(t) for i, t in texts.items()}, {i: plain_grams(t, bucket) for i, t in texts.items()}

    def odds(ids):
        out = []
        for j in (0, 1):
            count = {y: defaultdict(int) for y in (0, 1)}
            for i in ids:
                for b, n in grams[i][j].items():
                    count[labels[i]][b] += n
            total = {y: sum(count[y].values()) for y in (0, 1)}
            prior = lambda b, c=count, t=total: (c[0][b] + c[1][b] + 1) / (t[0] + t[1] + ranker.BUCKETS)
            share = lambda y, b, c=count, t=total, p=prior: (c[y][b] + ranker.ODDS_PRIOR * p(b)) / (t[y] + ranker.ODDS_PRIOR)
            out.append(lambda b, s=share: max(-4, min(4, math.log(s(1, b) / s(0, b)))))
        return out

    def means(i, by):
        return [sum(by[j](b) * n for b, n in grams[i][j].items()) / sum(grams[i][j].values()) if grams[i][j] else 0.0 for j in (0, 1)]

    folds = [odds([i for k, i in enumerate(train) if k % ranker.FOLDS != f]) for f in range(ranker.FOLDS)]
    x, y = np.array([own[i] + means(i, folds[k % ranker.FOLDS]) for k, i in enumerate(train)]), np.array([labels[i] for i in train])
    edges = [sorted(set(np.quantile(x[:, j], [k / ranker.BINS for k in range(1, ranker.BINS)]))) for j in range(x.shape[1])]

    def expand(row):
        z = [max(-4.0, min(4.0, (v - m) / max(s, 1e-9))) for v, m, s in zip(row, x.mean(axis=0), x.std(axis=0), strict=True)]
        for v, e in zip(row, edges, strict=True):
            at = sum(c <= v for c in e)
            z += [float(k == at) for k in range(len(e) + 1)]
        return z

    z = np.array([expand(r) for r in x])
    better, worse = ranker.pairs_of(y, ranker.PAIRS_EACH)
    assert (y[better] == 1).all() and (y[worse] == 0).all()
    d = z[better] - z[worse]
    w, v, step = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1 / (ranker.RIDGE + np.linalg.norm(d, 2) ** 2 / 4)
    for k in range(4000):  # accelerated descent on the loss itself
        g = ranker.RIDGE * v - d.T @ (1 / (1 + np.exp(d @ v)))
        w, old = v - step * g, w
        v = w + k / (k + 3) * (w - old)
    raw = z @ w
    at = np.quantile(raw, (y == 0).mean())
    shift = math.log(ranker.CUT / (1 - ranker.CUT))
    loss = lambda b: np.logaddexp(0, -(2 * y - 1) * (b * (raw - at) + shift)).sum()
    slope = min(np.exp(np.linspace(np.log(0.01), np.log(100), 20_000)), key=loss)
    every = odds(train)
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_quality_classifier"](spark, small).collect()}
    assert set(got) == set(texts)
    for i in texts:
        want = 1 / (1 + math.exp(-max(-30, min(30, slope * (float(np.array(expand(own[i] + means(i, every))) @ w) - at) + shift))))
        assert got[i]["score"] == pytest.approx(want, abs=2e-3), i
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)
