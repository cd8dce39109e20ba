"""Operators do the whole job: nothing is cut, left out or sampled."""

import random
from collections import Counter

import pytest

from skarn.operators import audit, extraction, joins, retrieval
from skarn.plans import catalog


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_only_the_last_section_is_cut(spark):
    long = "\n".join("a line of a section" for _ in range(200))
    texts = spark.createDataFrame([(1, f"305 One\n{long}\n306 Two\n{long}"), (2, f"305 One\n{long}\n306 Two"), (3, f"305 One\n{long}\n306 Two\nx\n305 One\n{long}")], "doc_id int, text string")
    assert rows(extraction.section_contents(texts), "doc_id", "number") == [(1, "305", long), (1, "306", long[:2000]), (2, "305", long), (3, "305", long + "\n" + long[:2000]), (3, "306", "x")]


def test_a_quote_counts_to_its_end(spark, tmp_path):
    head = "ducts of gypsum board are allowed where the air is dry enough for it"
    items = spark.createDataFrame([(1, f"{head} and nowhere else")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"say {head} and  nowhere else."), (2, f"say {head} and also elsewhere.")], "doc_id long, text string")
    assert rows(catalog.QUERIES["quote_containment"](spark, folder(tmp_path, benchmark=items, documents=docs))) == [(1, 1)]


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_coverage_finds_what_brute_force_finds(spark, once, least):
    rand = random.Random(7)
    text = lambda n: " ".join(f"w{int(rand.paretovariate(0.7)) % 30}" for _ in range(n))
    a, b = [(i, text(rand.randint(0, 9))) for i in range(40)], [(i, text(rand.randint(0, 30))) for i in range(60)]
    count = lambda t: Counter(set(t.split()) if once else t.split())
    want = [(i, j, n, n / len(list(x.elements()))) for i, s in a for j, t in b if (x := count(s)) and (n := (x & count(t)).total()) / x.total() >= least]
    frames = [spark.createDataFrame(r, f"{k} int, text string") for k, r in (("i", a), ("j", b))]
    assert rows(joins.token_coverage(*frames, ["i"], ["j"], least, once), "i", "j") == want


@pytest.mark.parametrize("name", ["set_token_coverage", "multiset_token_coverage"])
def test_a_passage_is_found_whatever_the_ids(spark, tmp_path, name):
    items = spark.createDataFrame([(77, "ducts of gypsum board"), (3, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(4, "the ducts of gypsum board are dry"), (5, "nothing")], "doc_id long, text string")
    assert rows(catalog.QUERIES[name](spark, folder(tmp_path, benchmark=items, documents=docs)).select("item_id", "doc_id")) == [(77, 4)]


def test_lines_of_all_documents_meet_all_passages(spark, tmp_path):
    items = spark.createDataFrame([(1, "other words"), (150, "Ducts of gypsum  board are dry")], "item_id long, text string")
    docs = spark.createDataFrame([(9000, "x\nof gypsum board\nducts of wet gypsum board\nno match in here")], "doc_id long, text string")
    d = folder(tmp_path, benchmark=items, documents=docs)
    assert [r[:2] for r in rows(catalog.QUERIES["span_match_scored"](spark, d), "line_id")] == [("9000:1", 150), ("9000:2", 150)]
    assert rows(catalog.QUERIES["reconciliation_report"](spark, d)) == [("even", 4, 2, 50.0)]


def test_rows_of_all_documents_are_grouped(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a\n\nb") for i in (199, 200, 70000)], "doc_id long, text string")
    assert rows(catalog.QUERIES["table_row_groups"](spark, folder(tmp_path, documents=docs)), "table_id", "row", "group") == [(i, at, g, 1) for i in (199, 200, 70000) for at, g in ((0, 0), (2, 1))]


def test_footnotes_find_the_table_that_pairs_would_find(spark):
    rand = random.Random(3)
    lines, tables = [(i, rand.randrange(5), rand.randrange(0, 3000, 10)) for i in range(80)], [(i, rand.randrange(4), rand.randrange(0, 3000, 10)) for i in range(60)]
    cost = lambda gap: gap if gap >= 0 else 1000 - gap
    want = [(i, min((cost(top - bottom), t) for t, p, bottom in tables if p == page)[1]) for i, page, top in lines if page < 4]
    got = audit.footnote_owner(spark.createDataFrame(lines, "line_id int, page int, top int"), spark.createDataFrame(tables, "table_id int, page int, bottom int"))
    assert rows(got, "line_id") == want


def test_no_id_is_left_out(spark, tmp_path):
    ids = spark.range(0, 1000, 7)
    orders = ids.selectExpr("id + 600 AS o_orderkey", "CAST(7 AS LONG) AS o_custkey", "'x' AS o_orderpriority")
    part = ids.selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(id % 20 AS INT) AS p_size")
    d = folder(tmp_path, orders=orders, part=part, customer=spark.range(1000).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey"))
    at = [(3 * i, 4 * (i % 20)) for i in range(0, 1000, 7)]
    near = sum(abs(x - u) <= 70 and abs(y - v) <= 40 for k, (x, y) in enumerate(at) for u, v in at[k + 1 :])
    counts = {n: catalog.QUERIES[f"{n}"](spark, d).count() for n in ("footnote_owner", "box_geometry", "block_tree", "box_texts")}
    assert counts == {"footnote_owner": 143, "box_geometry": near, "block_tree": 1000, "box_texts": 143}


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_in_blocks_is_the_nearest_of_all(spark, block):
    rand = random.Random(5)
    data = [(i, i % 3, [rand.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    cosine = lambda x, y: round(sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5, 6)
    want = [(q, i) for q, _, e in data if q % 10 == 0 for _, i in sorted((-cosine(e, o), i) for i, _, o in data if i != q)[:5]]
    v = spark.createDataFrame(data, "vec_id long, label long, embedding array<float>")
    assert sorted(rows(retrieval.nearest(v, v.where("vec_id % 10 = 0"), 5, block).select("q", "vec_id"))) == sorted(want)


def test_recall_has_every_hundredth_vector(spark, small):
    assert sorted(r[0] for r in rows(catalog.QUERIES["recall_at_k"](spark, small).select("q"))) == [0, 100, 200, 300, 400]
