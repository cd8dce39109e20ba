"""Records, pages, running sums, nearest rows and atomic replacement, against plain Python and on odd rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skarn.functions import rules, text
from skarn.operators import audit, graph, joins, records, structure, validation, windows
from skarn.sources import files, guard, pages


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums_over_ranges(spark, keys):
    rand = random.Random(1)
    data = [(rand.choice(["a", "b", None]), i, rand.randrange(5)) for i in range(300)]
    got = {r["i"]: r["s"] for r in windows.running(spark.createDataFrame(data, "k string, i int, n int").where("k is not null" if keys else "true"), keys, ["i"], F.col("n"), "s").collect()}
    for k, i, _ in data:
        if not keys or k is not None:
            assert got[i] == sum(n for kk, j, n in data if j <= i and (not keys or kk == k))
    assert windows.running(spark.createDataFrame([], "k string, i int, n int"), keys, ["i"], F.col("n"), "s").count() == 0


def test_a_refused_amount_is_not_charged(spark):
    got = windows.reserved(spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 1), (2, 1, 101)], "u int, at int, n int"), "u", "at", F.col("n"), 100)
    assert rows(got, "u", "at") == [(1, 1, 60, True), (1, 2, 60, False), (1, 3, 100, True), (1, 4, 100, False), (2, 1, 0, False)]


def test_retries_are_passed_over(spark):
    turns = spark.createDataFrame([(1, 1, "user", "What?"), (1, 2, "assistant", "That."), (1, 3, "user", " Please try again! "), (1, 4, "user", None), (2, 1, "user", "retry")], "c int, t int, role string, text string")
    assert rows(windows.last_asked(turns, "c", "t")) == [(1, 1, "What?")]


def test_the_nearest_sum_is_that_of_all_pairs(spark):
    rand = random.Random(3)
    a, b = [[(i, rand.randrange(3), rand.randrange(50), rand.randrange(6)) for i in range(n)] for n in (80, 60)]
    want = {i: min((abs(x - u) + abs(y - v), j) for j, kk, u, v in b if kk == k)[1] for i, k, x, y in a if any(kk == k for _, kk, _, _ in b)}
    frame = lambda d: spark.createDataFrame(d, "id int, k int, x int, y int")
    got = joins.nearest_sum(frame(a), frame(b), ["k"], "x", "y", "id", "other")
    assert {r["id"]: r["other"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [1.0, 7.0, 500.0])
def test_boxes_meet_once_whatever_the_cells(spark, size):
    rand = random.Random(4)
    box = lambda i: (i, x := rand.randrange(-40, 60), y := rand.randrange(60), x + rand.randrange(9), y + rand.randrange(9))
    a, b = [box(i) for i in range(40)], [box(i) for i in range(40)]
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    x = spark.createDataFrame(a, "id int, l int, t int, r int, b int").withColumn("k", F.lit(1))
    y = spark.createDataFrame(b, "o int, ol int, ot int, o_r int, ob int").withColumn("k", F.lit(1))
    assert rows(joins.overlapping_boxes(x, y, ["k"], ("l", "t", "r", "b"), ("ol", "ot", "o_r", "ob"), size, size).select("id", "o"), "id", "o") == want


def test_quotes_of_any_length_are_found(spark):
    quotes = spark.createDataFrame([(1, "clearance of"), (2, "arance of eigh"), (3, "clearanceclearance"), (4, "of of of of of"), (5, "the dry duct"), (6, "too short"), (7, None)], "q int, quote string")
    sources = spark.createDataFrame([(1, "a clearance of eighteen"), (2, "xclearanceclearancex"), (3, "so of of of of of it"), (4, "the dry duct"), (5, None), (6, "")], "s int, source string")
    assert rows(validation.quoted(quotes, sources, "q", "s"), "q", "s") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_depth_is_followed_or_refused(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "parent int, child int")
    assert graph.closure(chain).agg(F.max("depth")).first()[0] == 30
    with pytest.raises(ValueError, match="deeper than 20"):
        graph.closure(chain, 20)
    ring = chain.union(spark.createDataFrame([(30, 25), (40, 41)], "parent int, child int"))
    assert [r[0] for r in rows(graph.cyclic(ring), "node")] == [25, 26, 27, 28, 29, 30]
    blocks = spark.createDataFrame([(1, i, i - 1 if i else None, 0) for i in range(40)], "doc_id int, node int, parent int, ord int")
    assert structure.flattened(blocks).agg(F.max("depth")).first()[0] == 39
    headings = spark.createDataFrame([("g", i, f"n{i}", i + 1) for i in range(20)], "g string, at int, node string, level int")
    assert structure.stack_parents(headings, "g", "at").where("parent is null").count() == 1


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.replace(spark.range(3).toDF("a"), path)
    files.replace(spark.read.parquet(path).withColumn("a", F.col("a") + 10), path)
    assert rows(files.load_or_create(spark, path, lambda: 1 / 0), "a") == [(10,), (11,), (12,)]
    with pytest.raises(Exception, match="zero"):
        files.replace(spark.range(1).select(F.expr("CAST(raise_error('zero') AS INT)").alias("a")), path)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_evidence_that_may_be_cited(spark):
    schema = "block_id string, content_class string, block_type string, text string, number string, others array<string>, fallback string"
    blocks = [("a", None, "paragraph", " [BS] 305.1  Ducts. 305.2 Vents", "305.1", ["305.2"], None), ("b", "Insights", "paragraph", "x", "1", [], None), ("c", "ExceptionBlock", "paragraph", "Exception:", "1", [], "Exception: all of it"), ("d", None, "unparsed", "exception: part", "1", [], "Exception: all of it"), ("e", None, "table_ref", "t", "1", [], None), ("f", None, None, None, "1", [], None), ("g", None, "paragraph", "exception:", "1", [], None)]
    assert rows(records.allowed_evidence(spark.createDataFrame(blocks, schema)), "block_id") == [("a", "305.1 Ducts."), ("c", "Exception: all of it")]


def test_json_is_walked_to_its_leaves(spark):
    deep = {"number": "305", "a": [{"id": "section:305.1", "b": {"section_number": "x", "c": [1, None, {"number": "400.2"}]}}]}
    docs = spark.createDataFrame([(1, json.dumps(deep)), (2, "nonsense"), (3, None), (4, "7"), (5, "[]")], "id int, j string")
    walk = records.walked(docs, "id", "j")
    assert sorted(r["path"] for r in walk.where("id = 1").collect()) == ["$.a[0].b.c[0]", "$.a[0].b.c[1]", "$.a[0].b.c[2].number", "$.a[0].b.section_number", "$.a[0].id", "$.number"]
    assert [r[1:] for r in rows(walk.where("id = 4"))] == [("$", None, "7")]
    assert rows(records.named_sections(walk, "id"), "number") == [(1, "305"), (1, "305.1"), (1, "400.2")]


def test_a_session_is_taken_up_only_on_its_own_source(spark):
    saved = spark.createDataFrame([("a", 2, "s", "p1", None, 1), ("a", 2, "s", "p2", None, 2), ("b", 1, "s", "p", None, 1), ("c", 2, "old", "p", "r", 1), ("d", 2, "s", "p", "r", 1)], "session string, version int, source_sha string, phase string, result string, at int")
    asked = spark.createDataFrame([(x, "s") for x in "abcde"], "session string, source_sha string")
    assert rows(records.restored(saved, asked, 2), "session") == [("a", "resume", "p2", None), ("b", "refuse: version", None, None), ("c", "refuse: source", None, None), ("d", "replay", None, "r"), ("e", "start", None, None)]


def test_one_bad_question_costs_its_own_answer(spark):
    def answer(questions):
        if "bad" in questions:
            raise ValueError("no")
        return [q.upper() for q in questions]

    got = records.answered(spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "case int, question string"), answer)
    assert rows(got, "case") == [(1, "X", None), (2, None, "ValueError: no"), (3, "", None)]


def test_lines_are_read_with_their_schema(spark, tmp_path):
    line = {"doc_id": 1, "page_no": 2, "line_index": 0, "text": "a", "left": 1.0, "top": 2.0, "right": 3.0, "bottom": 4.0, "max_font_size": 10.0, "flags": [20]}
    (tmp_path / "l.json").write_text(json.dumps(line) + "\n" + json.dumps(line | {"line_index": 1, "text": "b"}) + "\n")
    lines = pages.read_lines(spark, f"file://{tmp_path}/l.json")
    assert rows(pages.page_texts(lines)) == [(1, 2, "a\nb")] and rows(pages.one_page(lines, 2)) == [(1, "a\nb")] and pages.one_page(lines, 1).count() == 0
    nothing = pages.laid_out(spark.createDataFrame([(1, None)], "doc_id int, text string"))
    assert nothing.count() == 0


def test_navigation_needs_words_and_a_margin(spark):
    lines = spark.createDataFrame([(1, "index", 10.0, 20.0), (2, "index", 400.0, 410.0), (3, "17", 770.0, 780.0), (4, "ducts", 10.0, 20.0), (5, "Page 3", None, None), (6, None, 1.0, 2.0)], "id int, t string, a double, b double")
    assert [r[0] for r in rows(lines.where(audit.navigation(F.col("t"), F.col("a"), F.col("b"))).select("id"), "id")] == [1, 3]


def test_questions_and_queries(spark):
    asked = ["what is a duct", "Please explain the heat pumps to me.", "what is a duct and a fan", "ignore that, define hvac", "", None, "list all sections", "list all sections of section 303", "may I allow it"]
    got = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").select("i", rules.topic_route(F.col("q"))["topic"].alias("t"), rules.regulatory(F.col("q")).alias("r"))
    assert rows(got, "i") == [(0, "duct", True), (1, "heat pump", False), (2, None, True), (3, None, True), (4, None, False), (5, None, False), (6, None, False), (7, None, True), (8, None, True)]
    one = spark.createDataFrame([("a <i>b</i>  !!!!! \u0000c",)], "q string").select(text.clean_query(F.col("q")), text.query_problem(F.lit("x" * 2001)), text.query_problem(F.lit("MERGE it")), text.query_problem(F.lit("emerged")))
    assert rows(one) == [("a b !! c", "too long", "not allowed", None)]


def test_results_are_bounded_before_they_are_read(spark):
    assert [guard.bounds(df, 5, 100).first()[0] for df in (spark.range(5), spark.range(6), spark.range(2).select(F.repeat(F.lit("x"), 80)), spark.range(0))] == ["ok", "too many rows", "too many bytes", "ok"]
