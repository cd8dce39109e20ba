"""Operators on small tables whose results are plain to see."""

import pytest
from pyspark.sql import functions as F

from skarn.functions import requirements, text
from skarn.operators import evidence, graph, joins, retrieval, validation, windows
from skarn.sources import files, guard
from skarn.streaming import events as stream


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    assert graph.closure(edges).count() == 6
    assert rows(graph.cyclic(edges), "node") == [("a",), ("b",), ("c",)]


def test_closure_of_nothing(spark):
    assert graph.closure(spark.createDataFrame([], "parent string, child string")).count() == 0


def test_asof_takes_the_last_row_before(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, "five"), (1, 3, "three"), (3, 1, "other")], "k int, t int, name string")
    found = lambda strict: {r["v"]: r["hit"] for r in joins.asof(left, right, ["k"], ["t"], {"hit": "name"}, strict).collect()}
    assert found(False) == {"x": "five", "y": None, "z": None}
    assert found(True) == {"x": "three", "y": None, "z": None}


def test_overlaps_come_once_whatever_the_cells(spark):
    a = spark.createDataFrame([(1, 0, 100), (2, 50, 51)], "id int, lo int, hi int").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(10, 40, 60), (11, 100, 200), (12, 300, 301)], "other int, s int, e int").withColumn("k", F.lit(1))
    want = [(1, 10), (1, 11), (2, 10)]
    for width in (1, 7, 1000):
        assert rows(joins.overlapping(a, b, ["k"], ("lo", "hi"), ("s", "e"), width).select("id", "other"), "id", "other") == want


def test_coverage_states(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    out = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (4, "d")], "k int, t string")
    assert [r[3] for r in rows(joins.coverage(src, out, "k", "t"), "k")] == ["matched", "title_mismatch", "missing", "output_only"]


def test_history_is_bounded_from_the_newest(spark):
    turns = spark.createDataFrame([(1, i, r, "x" * 10) for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv_id int, turn int, role string, text string")
    got = rows(windows.bounded_history(turns, "conv_id", "turn", most_turns=3, most_each=8, most_all=20).select("turn", F.length("content")), "turn")
    assert got == [(2, 4), (3, 8), (4, 8)]


def test_fusion_counts_a_method_once(spark):
    ranking = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 3, "a")], "owner int, rank int, method string")
    other = spark.createDataFrame([(2, 1, "b")], "owner int, rank int, method string")
    got = rows(retrieval.fuse([ranking, other]))
    assert [g[0] for g in got] == [2, 1]
    assert got[1][1] == pytest.approx(1 / 61, abs=1e-9)


def test_lexical_without_terms_is_empty(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    assert retrieval.lexical(docs, "a of").count() == 0


def test_quotes_meet_whole_sources(spark):
    quotes = spark.createDataFrame([(1, "arance of 18 inches is kept"), (2, "short"), (3, "not in any of the sources")], "q int, quote string")
    sources = spark.createDataFrame([("s", "A clearance of 18 inches is kept here"), ("t", "nothing")], "id string, source string")
    assert rows(validation.quoted(quotes, sources, "q", "id")) == [(1, "s")]


def test_requirement_records(spark):
    spans = spark.createDataFrame([("d", "s1", "section_text", "Exhaust ducts shall not be installed in plenums; notes follow."), ("d", "s2", "table_reference", "Ducts shall be sealed")], "document_id string, span_id string, source_type string, text string")
    got = requirements.requirements(spans).collect()
    assert [(r["predicate"], r["subject"], r["needs_review"]) for r in got] == [("PROHIBITED_IN", "Exhaust ducts", False)]


def test_text_expressions(spark):
    one = spark.createDataFrame([("See 901.2.1 and more  text", "901.2.1")], "t string, n string")
    got = one.select(text.section_number(F.col("t")), text.section_path(F.col("n")), text.section_level(F.col("n")), text.collapse(F.col("t")), text.token_estimate(F.lit("")), text.ngrams(F.array(F.lit("a")), 2), text.percentage(F.lit(1), F.lit(0))).first()
    assert tuple(got) == ("901.2.1", "/901/901.2/901.2.1", 3, "See 901.2.1 and more text", 1, [], 0.0)


def test_guard():
    assert guard.problem("SELECT 1 LIMIT 1") is None
    assert guard.problem("SELECT 'a;b' LIMIT 100;") is None
    assert guard.problem("DELETE FROM t") == "not a query"
    assert guard.problem("SELECT 1 LIMIT 101") == "limit above 100"
    assert guard.problem("x" * 9000) == "too long"


def test_guarded_run_refuses_large_results(spark):
    assert guard.run(spark, "SELECT 1 AS a LIMIT 1") == [{"a": 1}]
    with pytest.raises(ValueError):
        guard.run(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        guard.run(spark, "SELECT repeat('x', 200000) AS a LIMIT 1")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'say "x"'), (2, None, "y,z")], "k int, tags array<string>, t string")
    files.write_csv(df, str(tmp_path / "c"), ["k", "tags", "t"])
    back = files.read_csv(spark, str(tmp_path / "c"), "k int, tags string, t string")
    assert rows(back, "k") == [(1, '["a","b"]', 'say "x"'), (2, None, "y,z")]
    assert files.read_csv(spark, str(tmp_path / "missing"), "k int").count() == 0
    (tmp_path / "f.bin").write_bytes(b"abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert files.verified(spark, str(tmp_path / "f.bin"), digest).count() == 1
    assert files.verified(spark, str(tmp_path / "f.bin"), "0" * 64).count() == 0
    files.write_entities({"a": df}, str(tmp_path / "e"))
    assert files.conform(spark.read.parquet(str(tmp_path / "e/a")), spark.createDataFrame([], "t string, k long, extra int").schema).columns == ["t", "k", "extra"]
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": ["x"]}')
    assert rows(files.read_json(spark, str(tmp_path / "d.json"), "a int, b array<string>")) == [(1, ["x"])]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(files.upsert(old, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]


def test_distinct_passages_keep_the_first(spark):
    p = spark.createDataFrame([("s", 1, 2, "A  b"), ("s", 1, 1, "a B"), ("s", 2, 3, "a b")], "section string, page int, ord int, text string")
    assert rows(evidence.distinct_passages(p).select("ord"), "ord") == [(1,), (3,)]


def test_streamed_windows_equal_batch(spark, small):
    batch = stream.tumbling(spark.read.parquet(f"{small}/events.parquet"))
    live = stream.drain(stream.tumbling(stream.read(spark, small), late="1 day"), "tumbling_test")
    assert rows(live, "event_type", "start_s") == rows(batch, "event_type", "start_s")


def test_session_gaps_in_order(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (1, 300), (2, 1)], "u int, t int").withColumn("gap", F.col("t") - windows.before(["u"], ["t"], "t") > 100)
    assert rows(windows.islands(df, ["u"], ["t"], F.col("gap"), "s").select("u", "t", "s"), "u", "t") == [(1, 1, 1), (1, 5, 1), (1, 300, 2), (2, 1, 1)]
