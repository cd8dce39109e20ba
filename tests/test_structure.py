"""Structure, answer, refresh and rule operators on odd rows."""

import pytest
from pyspark.sql import functions as F

from skarn.functions import rules, similarity
from skarn.operators import answers, refresh, structure
from skarn.plans.tools import Tools


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_parents_skip_deeper_and_equal_levels(spark):
    h = spark.createDataFrame([("c", i, f"n{i}", level) for i, level in enumerate([1, 3, 2, 2, 4, 1, 2])], "ch string, ord int, node string, level int")
    assert [r[0] for r in rows(structure.stack_parents(h, "ch", "ord").orderBy("ord").select("parent"))] == [None, "n0", "n0", "n0", "n3", None, "n5"]
    assert structure.stack_parents(h.limit(0), "ch", "ord").count() == 0


def test_a_tree_comes_in_reading_order_and_a_cycle_is_left_out(spark):
    b = spark.createDataFrame([(1, "a", None, 1), (1, "b", "a", 2), (1, "c", "a", 1), (1, "d", None, 0), (1, "x", "y", 0), (1, "y", "x", 0)], "doc_id int, node string, parent string, ord int")
    assert rows(structure.flattened(b).select("node", "depth", "ordinal"), "ordinal") == [("d", 0, 0), ("a", 0, 1), ("c", 1, 2), ("b", 1, 3)]


def test_headings_that_overlap_are_taken_once(spark):
    b = spark.createDataFrame([("b", "305.1 Ducts and 305.1 Ducts again", ["305.1 Ducts", "305.1", "Ducts"]), ("e", "", []), ("n", None, None)], "block_id string, text string, headings array<string>")
    got = rows(structure.split_at_headings(b), "block_id", "part")
    assert got == [("b", 0, "305.1 Ducts", "305.1 Ducts and 305.1 Ducts again")]


def test_failed_checks_name_the_first(spark):
    good, bad = structure.sorted_out(spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, x int"), {"null": F.col("x").isNotNull(), "low": F.col("x") > 0})
    assert rows(good) == [(1, 5)] and rows(bad.select("id", "reason"), "id") == [(2, "null"), (3, "low")]


def test_a_verdict_too_many_is_not_support(spark):
    claims = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "answer int, claim_index int")
    given = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, True), (2, 0, True)], "answer int, claim_index int, supported boolean").withColumns({"qualifications_complete": F.lit(True), "relevant": F.lit(True)})
    assert rows(answers.verdicts(claims, given), "answer") == [(1, True), (2, False), (3, False)]


def test_a_correction_must_name_one_case(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    assert rows(answers.corrected(cases, spark.createDataFrame([(1, None)], "id int, v string"), "id", "v"), "id", "v")[0] == (1, None)
    with pytest.raises(Exception, match="not just one case"):
        answers.corrected(cases, spark.createDataFrame([(2, "x")], "id int, v string"), "id", "v").collect()


def test_changes_apply_only_to_what_was_planned_on(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, v string")
    told = refresh.fingerprint(df.orderBy(F.desc("id")))
    refresh.apply(df, told, lambda x: x.distinct(), f"file://{tmp_path}/new")
    assert spark.read.parquet(f"file://{tmp_path}/new").count() == 2
    with pytest.raises(ValueError, match="has changed"):
        refresh.apply(df.distinct(), told, lambda x: x, f"file://{tmp_path}/other")


def test_only_missing_texts_are_embedded(spark):
    texts = spark.createDataFrame([("s1", "a b"), ("s1", "a b"), ("s2", None)], "sha string, text string")
    cache = spark.createDataFrame([("s1", [7.0]), ("s3", [1.0])], "sha string, embedding array<float>")
    got = {r["sha"]: list(r["embedding"]) for r in refresh.embedded(texts, cache, refresh.hashed_embedder(2)).collect()}
    assert got == {"s1": [7.0], "s2": [0.0, 0.0]}


def test_operations_have_names_and_bounds(spark):
    docs = spark.createDataFrame([(1, "duct work here"), (2, "other")], "doc_id long, text string")
    embed = refresh.hashed_embedder(8)
    vectors = spark.createDataFrame([(1, embed(["duct work here"])[0]), (2, embed(["other"])[0])], "vec_id long, embedding array<double>")
    tools = Tools(spark, docs, vectors, embed, {"docs": docs})
    assert tools.execute("vector_search", {"query": "duct work here", "top_k": 99}).first()["vec_id"] == 1
    assert tools.execute("hybrid_search", {"query": "duct work", "top_k": 1}).first()["owner"] == 1
    assert tools.execute("search_tables", {"query": "SELECT doc_id FROM {docs} ORDER BY doc_id LIMIT 1"}) == [{"doc_id": 1}]
    assert tools.execute("general_info", {"question": "What is a heat pump?"}) == {"action": "answer", "topic": "heat pump"}
    for name, arguments in (("other", {}), ("vector_search", {"query": " "}), ("search_tables", {"query": "DROP TABLE x"})):
        with pytest.raises(ValueError):
            tools.execute(name, arguments)


def test_places_of_folded_text_point_into_the_original(spark):
    text = " Ａｂ ½ﬁ  c "
    got = spark.createDataFrame([(text,)], "s string").select(similarity.folded("s").alias("x")).first()["x"]
    assert got["text"] == "ab 1⁄2fi c" and len(got["places"]) == len(got["text"])
    assert text[got["places"][0]] == "Ａ" and text[got["places"][-1]] == "c"


def test_boxes_turn_with_the_page(spark):
    b = spark.range(1).select(F.expr("named_struct('l', 1D, 't', 90D, 'r', 2D, 'b', 80D)").alias("b")).select(rules.box(F.col("b"), 100.0).alias("x")).first()["x"]
    assert tuple(b) == (1.0, 10.0, 2.0, 20.0)
