"""The pipeline against the same stages by brute force."""

import re
from collections import defaultdict

import pytest

pytest.importorskip("skarn.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from skarn.llm import quality  # noqa: E402
from tests.llm.test_oracles import brute_components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_verdicts(docs):
    """Whether each row of docs is kept: base rules, and what its host's shrunk rates say."""
    fails = []
    for d in docs:
        text = d["text"] or ""
        w = WORD.findall(text)
        runs = defaultdict(list)
        for i in range(len(w) - 2):
            runs[tuple(w[i : i + 3])].append(i)
        rep = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        few, same = len(w) < 50, 100 * len(rep) > 50 * len(w)
        fails.append((few, same, 100 * sum(c in "#*$%&|<>" for c in text) > 10 * len(w), len(lines) - len(set(lines)) >= 3, chars < 2 * len(w) or chars > 12 * len(w), few or same))
    hosts = defaultdict(list)
    for d, f in zip(docs, fails, strict=True):
        if d["source"] is not None:
            hosts[d["source"]].append(f)
    shrunk, means = {}, []
    for rule in range(6):
        rates = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        m = sum(rates.values()) / len(rates) if rates else 0
        v = sum((r - m) ** 2 for r in rates.values()) / len(rates) if rates else 0
        strength = min(max(m * (1 - m) / v - 1, 1), 1000) if v else 1000
        means.append(m)
        for h, fs in hosts.items():
            shrunk[h, rule] = (sum(f[rule] for f in fs) + m * strength) / (len(fs) + strength)
    out = []
    for d, f in zip(docs, fails, strict=True):
        host = d["source"]
        bad = f[5] or host is not None and (max(shrunk[host, r] for r in range(6)) > 0.8 or any(f[r] and shrunk[host, r] >= means[r] - 1e-9 for r in (2, 3, 4)))
        out.append(not bad)
    return out


def brute(docs):
    """(doc_id, words) after the first four stages."""
    docs = [d for d, kept in zip(docs, quality_verdicts(docs), strict=True) if kept]
    last = {}
    for d in docs:
        last[d["text"]] = max(last.get(d["text"], -1), d["doc_id"])
    docs = [d for d in docs if last[d["text"]] == d["doc_id"]]
    parts = brute_components({d["doc_id"]: d["text"] for d in docs}, 5, 80, 100)
    docs = sorted((d for d in docs if parts[d["doc_id"]][1] == d["doc_id"]), key=lambda d: d["doc_id"])
    first: dict = {}
    for d in docs:
        w = WORD.findall(d["text"])
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), d["doc_id"])
    out = {}
    for d in docs:
        w = WORD.findall(d["text"])
        gone = {x for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < d["doc_id"] for x in range(j, j + 50)}
        out[d["doc_id"]] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, small)
        assert got.columns == docs.columns
    want = brute([r.asDict() for r in docs.collect()])
    assert {r["doc_id"]: WORD.findall(r["text"]) for r in got.collect()} == want


def test_host_verdicts_act_on_the_tables(spark):
    """Some documents pass the base rules and go for their host; others that fail the same rule stay on a better host."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    want = {d["doc_id"]: kept for d, kept in zip(rows, quality_verdicts(rows), strict=True)}
    got = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.judge(spark, docs).collect()}
    assert {i: k for i, (k, _) in got.items()} == want
    by_host = [i for i, (k, base) in got.items() if not k and not base]
    assert by_host and len(by_host) < sum(k for k, _ in got.values()) / 5


def test_odd_rows_go_through_all_stages(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    body = " ".join(f"v{i}" for i in range(90))
    rows = [(1, None, None), (2, "", "s"), (None, long, "s"), (3, long, None), (3, long, "t"), (4, f"{body} x", "s"), (5, f"{body} y", "s"), (4, f"{body} x", "s"), (6, "one", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int, row string, `a.b` int")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
    kept = sorted((r["doc_id"], len(WORD.findall(r["text"]))) for r in out.collect())
    assert kept == [(3, 20_000), (4, 91)]
    pieces = corpus_pipeline.pack(spark, out, "").collect()
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_run_packs_what_is_left(spark, small):
    out = corpus_pipeline.run(spark, small).collect()
    assert out and all(0 < r["length"] <= 4096 for r in out)
    assert len(corpus_pipeline.STAGES) == 5


def test_an_empty_corpus_passes_through(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, small)
        assert none.count() == 0
        none = none if "text" in none.columns else spark.read.parquet(f"{small}/documents.parquet").limit(0)
