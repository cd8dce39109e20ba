"""Queries whose cost grew faster than their input: what they shuffle, how they are dealt, and that nothing is lost for it."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from skarn.functions import coverage
from skarn.operators import audit, joins, retrieval, validation
from skarn.plans import catalog


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, key, data):
    return spark.createDataFrame(data, f"{key} int, text string")


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("few", ["want", "offer"])
def test_a_small_side_goes_to_the_tasks_and_loses_nothing(spark, tmp_path, once, few):
    rand = random.Random(11)
    text = lambda n: " ".join(f"W{int(rand.paretovariate(0.7)) % 40}" for _ in range(n))
    small, large = [(i, text(rand.randint(0, 12))) for i in range(9)], [(i, text(rand.randint(0, 40))) for i in range(400)] + [(400, None), (401, "")]
    a, b = (small, large) if few == "want" else (large, small)
    count = lambda t: Counter(set((t or "").split()) if once else (t or "").split())
    want = [(i, j, n, n / x.total()) for i, s in a for j, t in b if (x := count(s)) and (n := (x & count(t)).total()) / x.total() >= 0.3]
    d = folder(tmp_path, a=texts(spark, "i", a), b=texts(spark, "j", b))
    frames = [spark.read.parquet(f"{d}/{n}.parquet") for n in "ab"]
    got = joins.token_coverage(*frames, ["i"], ["j"], 0.3, once)
    assert "hashpartitioning" not in plan(got)  # no row of a token is shuffled
    assert rows(got, "i", "j") == want
    assert rows(joins.token_coverage(*frames, ["i"], ["j"], 0.3, once, most=3), "i", "j") == want  # two large sides


@pytest.mark.parametrize("once", [True, False])
def test_parts_of_a_batch_count_as_the_whole(monkeypatch, once):
    rand = random.Random(13)
    text = lambda n: " ".join(f"w{rand.randrange(30)}" for _ in range(n))
    counts = [(i, w, 1 if once else n) for i in range(20) for w, n in Counter(text(8).split()).items()]
    index = coverage.Index(pa.table(dict(zip("iwn", map(list, zip(*counts, strict=True)), strict=True))), ["i"])
    batch = pa.RecordBatch.from_pydict({"j": list(range(200)), "text": [text(rand.randrange(30)) for _ in range(200)]})
    run = lambda: [tuple(r.values()) for b in coverage.covered(index, ["j"], ["j", "i", "n", "total"], 0.3, once, True, 1)(iter([batch])) for r in b.to_pylist()]
    whole = run()
    for cells in (1, 64, 1000):
        monkeypatch.setattr(coverage, "CELLS", cells)
        assert whole and sorted(run()) == sorted(whole)


def test_texts_of_one_key_count_together(spark):
    got = joins.token_coverage(texts(spark, "i", [(1, "a b c d")]), texts(spark, "j", [(1, "a b"), (1, "c"), (2, "a b"), (None, "a b c d")]), ["i"], ["j"], 0.6, False)
    assert rows(got) == [(1, 1, 3, 0.75)]


def test_letters_that_become_ascii(spark):
    # A dotted I and the Kelvin sign are the letters beyond ASCII whose lower case has an ASCII letter.
    data = [(i, f"x{chr(i)}y") for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    want = {r[0]: r[1] for r in texts(spark, "i", data).selectExpr("i", "regexp_extract_all(lower(text), '[a-z0-9]+', 0)").collect()}
    assert all(coverage._tokens(t) == want[i] for i, t in data)


@pytest.mark.parametrize("name", ["multiset_token_coverage", "set_token_coverage"])
def test_documents_are_not_shuffled_by_token(spark, small, name):
    assert "hashpartitioning" not in plan(catalog.QUERIES[name](spark, small))


def lines_and_targets(spark, tmp_path):
    rand = random.Random(17)
    text = lambda n: " ".join(f"w{rand.randrange(25)}" for _ in range(n))
    targets = [(i, i, text(10)) for i in range(20)]
    lines = [(f"{i}:0", text(rand.randrange(8))) for i in range(300)] + [("300:0", targets[3][2].upper()), ("301:0", None), ("302:0", " ".join(targets[5][2].split()[:4]))]
    d = folder(tmp_path, lines=spark.createDataFrame(lines, "line_id string, text string"), targets=spark.createDataFrame(targets, "target_id int, ord int, target string"))
    return lines, targets, spark.read.parquet(f"{d}/lines.parquet"), spark.read.parquet(f"{d}/targets.parquet")


def best_targets(lines, targets):
    want = []
    for i, t in lines:
        own = set((t or "").lower().split())
        met = [(-round(0.56 * c + 0.18 * (t.lower() in x), 6), o, k, c) for k, o, x in targets if len(own) >= 3 and (c := len(own & set(x.split())) / len(own)) >= 0.6]
        want += [(i, min(met)[2], round(min(met)[3], 6), -min(met)[0])] if met else []
    return sorted(want)


@pytest.mark.parametrize("most", [None, 3])
def test_lines_find_the_target_that_brute_force_finds(spark, tmp_path, monkeypatch, most):
    lines, targets, a, b = lines_and_targets(spark, tmp_path)
    if most:  # many targets: lines and targets meet on rare tokens
        monkeypatch.setattr(audit, "line_coverage", lambda *x: joins.line_coverage(*x, most=most))
    got = audit.span_matches_anywhere(a, b)
    assert most or plan(got).count("hashpartitioning") <= 2  # of matches, for their targets and for the best of a line
    assert sorted(rows(got)) == best_targets(lines, targets)


def test_a_report_shuffles_no_tokens(spark, small):
    p = plan(catalog.QUERIES["reconciliation_report"](spark, small))
    assert not any("w#" in x.split("]")[0] for x in p.split("hashpartitioning(")[1:]) and "regexp_extract_all" not in p


def test_lines_are_not_shuffled_by_token(spark, small):
    p = plan(catalog.QUERIES["span_match_scored"](spark, small))
    assert "regexp_extract_all" not in p and p.count("hashpartitioning") <= 2


def test_terms_are_counted_by_owner(spark, tmp_path):
    docs = [(1, "a B a"), (2, "b, c"), (2, "B d"), (None, "a e"), (None, "a"), (3, None), (4, "")]
    got = retrieval.term_totals(texts(spark, "doc_id", docs))
    assert rows(got, "term") == [("a", 1, 4), ("b", 2, 3), ("c", 1, 1), ("d", 1, 1), ("e", 0, 1)]


def test_postings_are_not_shuffled(spark, small):
    p = plan(catalog.QUERIES["inverted_index_terms"](spark, small))
    assert p.count("hashpartitioning(") == 1 and "hashpartitioning(term#" in p


def test_full_counters_are_handed_on(monkeypatch):
    monkeypatch.setattr(coverage, "CELLS", 2)
    batch = pa.RecordBatch.from_pydict({"owned": [True] * 3, "text": ["a b", "b b", "c"]})
    got = [tuple(r.values()) for b in coverage.term_totals(iter([batch])) for r in b.to_pylist()]
    assert got == [("a", 1, 1), ("b", 1, 1), ("b", 1, 2), ("c", 1, 1)]


def test_quantities_are_dealt_over_tasks(spark, small):
    assert "hashpartitioning(id#" in plan(catalog.QUERIES["quantity_bindings"](spark, small))


def test_every_spelling_of_a_unit_is_named(spark):
    spread = lambda w: w.upper().replace(" ", " \t ").replace("/", " / ")
    cases = [(unit, w, f) for unit, words in validation.UNITS.items() for w in words for f in (str, str.lower, spread)]
    data = [(i, f"is 1,250.50{sep}{f(w)}; then") for i, (_, w, f) in enumerate(cases) for sep in (["", " ", " - "][i % 3],)]
    assert rows(validation.quantities(texts(spark, "id", data)), "id") == [(i, 0, 2501, 2, unit) for i, (unit, _, _) in enumerate(cases)]


def test_fractions_are_reduced_however_long_euclid_takes(spark):
    a, b, pairs = 1, 1, []
    while b < 2**31:
        pairs, (a, b) = pairs + [(b, a), (a, b)], (b, a + b)
    pairs += [(k * x, k * y) for x, y in pairs for k in (2, 6, 10) if k * max(x, y) < 2**62] + [(0, 7), (12, 1), (5, 5)]
    data = [(i, f"-{x}/{y} psi") for i, (x, y) in enumerate(pairs)]
    want = [(i, 0, -x // math.gcd(x, y), y // math.gcd(x, y), "psi") for i, (x, y) in enumerate(pairs)]
    assert rows(validation.quantities(texts(spark, "id", data)), "id") == want


def plain_pairs(same_key, small, large, once, least):
    """(i, j, covered, share) by brute force; rows of one key are one text with `same_key`, null keys then count for nothing."""
    if same_key:
        small, large = ([(k, " ".join(t or "" for i, t in x if i == k)) for k in {i for i, _ in x} - {None}] for x in (small, large))
    count = lambda t: Counter(set((t or "").split()) if once else (t or "").split())
    want = [(i, j, n, n / x.total()) for i, s in small for j, t in large if (x := count(s)) and (n := (x & count(t)).total()) / x.total() >= least]
    return sorted(want, key=str)


def repeated_keys():
    rand = random.Random(19)
    text = lambda n: " ".join(f"w{int(rand.paretovariate(0.7)) % 40}" for _ in range(n))
    small = [(i, text(rand.randint(0, 12))) for i in [*range(8), 3, 3, None]]
    return small, [(j, text(rand.randint(0, 30))) for j in [*range(300), 7, 7, 7, 250, None, None]]


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("by", ["token_coverage", "row_coverage"])
def test_keys_that_repeat(spark, tmp_path, once, turned, by):
    small, large = repeated_keys()
    a, b = (large, small) if turned else (small, large)
    d = folder(tmp_path, a=texts(spark, "i", a), b=texts(spark, "j", b))
    frames = [spark.read.parquet(f"{d}/{n}.parquet") for n in "ab"]
    want = plain_pairs(by == "token_coverage", a, b, once, 0.3)
    for most in (1 << 18, 3):
        assert sorted(rows(getattr(joins, by)(*frames, ["i"], ["j"], 0.3, once, most=most)), key=str) == want


def test_a_repeated_id_moves_no_other_document(spark, tmp_path, same):
    small, large = repeated_keys()
    d = folder(tmp_path, benchmark=texts(spark, "item_id", small), documents=texts(spark, "doc_id", large))
    got = catalog.QUERIES["set_token_coverage"](spark, d)
    assert "hashpartitioning" not in plan(got)
    same(got, catalog.ORACLE["set_token_coverage"], d)
    d = folder(tmp_path / "keyed", benchmark=texts(spark, "item_id", small), documents=texts(spark, "doc_id", [x for x in large if x[0] is not None]))
    got = catalog.QUERIES["multiset_token_coverage"](spark, d)
    assert "MapInArrow" in plan(got)
    same(got, catalog.ORACLE["multiset_token_coverage"], d)


@pytest.mark.parametrize("once", [True, False])
def test_only_lines_with_enough_known_tokens_are_counted(monkeypatch, once):
    index = coverage.Index(pa.table({"i": [1, 1, 1, 2], "w": ["a", "b", "c", "d"], "n": [1, 1, 1, 1]}), ["i"])
    met, shared = [], coverage._shared
    monkeypatch.setattr(coverage, "_shared", lambda index, ids: met.extend(ids) or shared(index, ids))
    lines = ["a b c", "a b x y z", "a b c x y", "a b", "a b d", "", None]
    batch = pa.RecordBatch.from_pydict({"j": list(range(7)), "text": lines})
    got = [tuple(r.values()) for b in coverage.covered(index, ["j"], ["j", "i", "n", "total"], 0.6, once, False, 3)(iter([batch])) for r in b.to_pylist()]
    assert got == [(0, 1, 3, 3), (2, 1, 3, 5), (4, 1, 2, 3)]
    assert [len(x) for x in met] == [3, 0, 3, 0, 3, 0, 0]  # two known tokens of five are too few
