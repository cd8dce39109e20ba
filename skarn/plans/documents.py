"""Queries of the extraction operators, over stated texts and over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import extraction as E
from skarn.operators import graph, joins, retrieval
from skarn.plans.queries import query
from skarn.sources.tables import sql, table


@query("SELECT CAST(l_suppkey AS BIGINT) AS source, l_returnflag AS type, l_linenumber AS target, min(l_orderkey) AS code_ref FROM lineitem GROUP BY 1, 2, 3")
def edge_dedupe_first_wins(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("target"), F.col("l_orderkey").alias("code_ref"))
    return E.deduplicated_edges(edges, "code_ref")


_PART_BOXES = "SELECT p_partkey AS id, p_brand, p_partkey * 3.0D AS l, p_size * 4.0D AS t, p_partkey * 3.0D + 60 AS r, p_size * 4.0D + 30 AS b FROM {part}"


@query(f"""WITH b AS ({_PART_BOXES.format(part='part').replace('0D', '0')})
SELECT a.id, b.id AS other, CAST(round(greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) / 1800, 6) AS DOUBLE) AS overlap,
CAST(round(sqrt(power(greatest(b.l - a.r, a.l - b.r, 0), 2) + power(greatest(b.t - a.b, a.t - b.b, 0), 2)), 6) AS DOUBLE) AS gap
FROM b a JOIN b ON a.p_brand = b.p_brand AND a.id < b.id AND a.l - 5 <= b.r + 5 AND b.l - 5 <= a.r + 5 AND a.t - 5 <= b.b + 5 AND b.t - 5 <= a.b + 5""")
def box_geometry(spark, d):
    """Overlap and gap of all boxes of a brand that are near one another: pairs meet in cells, with five units added around."""
    parts = sql(spark, d, _PART_BOXES)
    around = parts.select("*", (F.col("l") - 5).alias("l5"), (F.col("t") - 5).alias("t5"), (F.col("r") + 5).alias("r5"), (F.col("b") + 5).alias("b5"))
    both = joins.overlapping_boxes(around, around.select("p_brand", *[F.col(c).alias(f"o_{c}") for c in around.columns if c != "p_brand"]), ["p_brand"], ("l5", "t5", "r5", "b5"), ("o_l5", "o_t5", "o_r5", "o_b5"), 200, 120).where("id < o_id")
    box = lambda p: F.struct(F.col(f"{p}l").alias("left"), F.col(f"{p}t").alias("top"), F.col(f"{p}r").alias("right"), F.col(f"{p}b").alias("bottom"))
    return both.select("id", F.col("o_id").alias("other"), F.round(E.box_overlap(box(""), box("o_")), 6).alias("overlap"), F.round(E.box_gap(box(""), box("o_")), 6).alias("gap"))


@query("""WITH q AS (SELECT c_custkey AS id, c_nationkey % 7 AS k FROM customer), h AS (SELECT id, k, 'r' || (k % 5) AS root FROM q)
SELECT id, CASE WHEN k = 0 THEN 'exact' ELSE 'vector' END AS route, CASE WHEN k = 0 THEN 'n0' ELSE 'n' || k || ',r' || (SELECT n_regionkey FROM nation WHERE n_nationkey = k) END AS sections FROM h""")
def retrieval_router(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 7).alias("k"))
    edges = sql(spark, d, "SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS child FROM {nation}")
    up = graph.ancestors(edges, edges.select(F.col("child").alias("node"))).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("ancestor")), ",").alias("a"))
    node = F.concat(F.lit("n"), "k")
    routed = asked.withColumn("node", node).join(up, "node", "left")
    return routed.select("id", F.when(F.col("k") == 0, "exact").otherwise("vector").alias("route"), F.when(F.col("k") == 0, F.col("node")).otherwise(F.concat_ws(",", "node", "a")).alias("sections"))


@query("""WITH g AS (SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id))
SELECT CAST(round(avg(CASE WHEN toxic = 1 THEN CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END END), 6) AS DOUBLE) AS abstention, round(avg(CAST(n_chars > 500 AS INTEGER)), 6) AS long_rate, bool_or(toxic = 1) AS any_toxic, bool_and(quality >= 0) AS all_rated FROM g""")
def golden_metrics(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    negative = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 1.0).otherwise(0.0))
    return g.agg(F.round(F.avg(negative), 6).alias("abstention"), F.round(F.avg((F.col("n_chars") > 500).cast("int")), 6).alias("long_rate"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"), F.bool_and(F.col("quality") >= 0).alias("all_rated"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_terms, CAST(len(list_distinct(ws)) AS INTEGER) AS n_distinct, ws[1] AS first_term FROM d WHERE len(ws) > 0""")
def term_statistics(spark, d):
    ws = retrieval.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", ws.alias("ws")).where("size(ws) > 0").select("doc_id", F.size("ws").alias("n_terms"), F.size(F.array_distinct("ws")).alias("n_distinct"), F.get("ws", F.lit(0)).alias("first_term"))
