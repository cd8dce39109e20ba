"""Queries of the structure, answer, refresh and rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import rules
from skarn.operators import answers, joins, refresh, structure
from skarn.plans.queries import ORACLE, query
from skarn.plans.tools import Tools
from skarn.sources.tables import sql, table

# --- structure ------------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT user_id AS grp, event_id AS ord, 1 + event_id % 5 AS level FROM events)
SELECT grp, ord, CAST(level AS BIGINT) AS level, (SELECT max(b.ord) FROM h b WHERE b.grp = a.grp AND b.ord < a.ord AND b.level < a.level) AS parent FROM h a""")
def stack_parents(spark, d):
    h = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("ord"), F.col("event_id").alias("node"), (1 + F.col("event_id") % 5).alias("level"))
    return structure.stack_parents(h, "grp", "ord").select("grp", "ord", "level", "parent")


@query("""WITH RECURSIVE n AS (SELECT c_custkey // 50 AS doc_id, c_custkey AS node, CASE WHEN c_custkey % 50 > 0 THEN c_custkey - c_custkey % 50 + (c_custkey % 50 - 1) // 2 END AS parent, c_custkey % 7 AS ord FROM customer),
t AS (SELECT doc_id, node, [ord] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.node, list_append(t.path, n.ord) FROM t JOIN n ON n.doc_id = t.doc_id AND n.parent = t.node)
SELECT doc_id, node, CAST(len(path) - 1 AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, node) - 1 AS INTEGER) AS ordinal FROM t""")
def block_tree(spark, d):
    """All customers, in trees of 50 blocks with two children each."""
    b = sql(spark, d, "SELECT c_custkey div 50 AS doc_id, c_custkey AS node, CASE WHEN c_custkey % 50 > 0 THEN c_custkey - c_custkey % 50 + (c_custkey % 50 - 1) div 2 END AS parent, c_custkey % 7 AS ord FROM {customer}")
    return structure.flattened(b)


@query("""WITH s AS (SELECT l_orderkey AS block, l_partkey % 3 AS span, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)
SELECT o_orderkey AS req, o_custkey AS section, CASE WHEN s.lo IS NULL THEN coalesce(CAST(w.owner AS VARCHAR), 'section:unassigned') WHEN s.lo = s.hi THEN CAST(s.lo AS VARCHAR) ELSE 'section:unassigned' END AS new_section
FROM orders LEFT JOIN s ON s.block = o_orderkey AND s.span = o_orderkey % 3 LEFT JOIN (SELECT o_orderkey AS block, o_custkey AS owner FROM orders WHERE o_orderkey % 5 <> 0) w ON w.block = o_orderkey""")
def owner_plan(spark, d):
    reqs = sql(spark, d, "SELECT o_orderkey AS req, CAST(o_custkey AS STRING) AS section, o_orderkey AS block, o_orderkey % 3 AS span FROM {orders}")
    owners = sql(spark, d, "SELECT o_orderkey AS block, CAST(o_custkey AS STRING) AS owner FROM {orders} WHERE o_orderkey % 5 <> 0")
    splits = sql(spark, d, "SELECT l_orderkey AS block, l_partkey % 3 AS span, CAST(l_suppkey AS STRING) AS owner FROM {lineitem} WHERE l_linenumber > 3")
    return structure.owner_plan(reqs, owners, splits).select("req", F.col("section").cast("long").alias("section"), "new_section")


@query("""SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 50 THEN 'short' WHEN lang NOT IN ('en', 'fr') THEN 'language' END AS reason FROM documents WHERE text IS NULL OR length(text) < 50 OR lang NOT IN ('en', 'fr')""")
def dead_letters(spark, d):
    _, bad = structure.sorted_out(table(spark, d, "documents"), {"short": F.length("text") >= 50, "language": F.col("lang").isin("en", "fr")})
    return bad.select("doc_id", "reason")


@query("""WITH own AS (SELECT s_nationkey AS chapter, s_suppkey AS number FROM supplier WHERE s_suppkey % 4 <> 0), u AS (SELECT *, 'own' AS source FROM own UNION ALL SELECT s_nationkey, s_suppkey, 'inventory' FROM supplier WHERE s_suppkey NOT IN (SELECT number FROM own))
SELECT chapter, number, source, CAST(row_number() OVER (PARTITION BY chapter ORDER BY number) - 1 AS INTEGER) AS ordinal FROM u""")
def heading_supplement(spark, d):
    every = sql(spark, d, "SELECT s_nationkey AS chapter, s_suppkey AS number FROM {supplier}")
    return structure.supplemented(every.where("number % 4 <> 0"), every, "number", ["chapter"])


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS owner, s_name AS name FROM supplier), b AS (SELECT s_suppkey AS id, s_nationkey + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS owner, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS name FROM supplier)
SELECT id, 'owner' AS field, CAST(a.owner AS VARCHAR) AS before, CAST(b.owner AS VARCHAR) AS after FROM a JOIN b USING (id) WHERE a.owner <> b.owner UNION ALL SELECT id, 'name', a.name, b.name FROM a JOIN b USING (id) WHERE a.name IS DISTINCT FROM b.name""")
def change_log(spark, d):
    a = sql(spark, d, "SELECT s_suppkey AS id, s_nationkey AS owner, s_name AS name FROM {supplier}")
    b = a.withColumn("owner", F.col("owner") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).withColumn("name", F.when(F.col("id") % 5 != 0, F.col("name")))
    return structure.changes(a, b, "id", ["owner", "name"])


# --- rules ----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), 'Page \\d+', '', 'g'), '[\\t\\v\\f\\r ]*\\n[\\t\\v\\f\\r ]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents""")
def cleaned_text(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.cleaned(F.col("text")).alias("cleaned"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS page, CASE WHEN event_id % 7 = 0 THEN 'a' WHEN event_id % 7 = 1 THEN 'unparsed' ELSE 'p' || event_id END AS block FROM events""")
def coerced_keys(spark, d):
    e = table(spark, d, "events")
    page = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), "user_id")).otherwise(F.col("user_id").cast("string"))
    block = F.when(F.col("event_id") % 7 == 0, F.lit(rules.REPAIR_PREFIX + "a")).when(F.col("event_id") % 7 == 1, F.lit("unparsed" + rules.REPAIR_MARK + "9")).otherwise(F.concat(F.lit("p"), "event_id"))
    return e.select("event_id", rules.page_of(page).alias("page"), rules.block_of(block).alias("block"))


# --- answers and evaluation -----------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_orderkey AS answer, l_linenumber AS i FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey AS answer, l_linenumber AS i, count(*) AS n, bool_and(l_quantity > 2) AS ok FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL)
SELECT answer, bool_and(c.i IS NOT NULL AND coalesce(n = 1 AND ok, false)) AS supported FROM c FULL JOIN g USING (answer, i) GROUP BY answer""")
def verdict_completeness(spark, d):
    given = sql(spark, d, "SELECT l_orderkey AS answer, l_linenumber AS claim_index, l_quantity > 2 AS supported, true AS qualifications_complete, true AS relevant FROM {lineitem} WHERE l_linenumber < 6")
    claims = sql(spark, d, "SELECT DISTINCT l_orderkey AS answer, l_linenumber AS claim_index FROM {lineitem}")
    return answers.verdicts(claims, given)


@query("""SELECT user_id AS question, turn, event_id AS ord, CASE WHEN turn = min(turn) OVER (PARTITION BY user_id, event_type, page) THEN 'new' ELSE 'existing' END AS state FROM (
  SELECT user_id, event_id // 300 AS turn, event_id, event_type, event_id % 3 AS page, row_number() OVER (PARTITION BY user_id, event_id // 300, event_type, event_id % 3 ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def observation_compaction(spark, d):
    p = sql(spark, d, "SELECT user_id AS question, event_id DIV 300 AS turn, event_id AS ord, event_type AS section, event_id % 3 AS page FROM {events}")
    return answers.compacted(p).select("question", "turn", "ord", "state")


@query("""SELECT event_id, CAST(sum(event_id % 50) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS tokens_by_event_type, CAST(sum(event_id % 50) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS BIGINT) AS tokens_by_user_id FROM events""")
def usage_by_grain(spark, d):
    calls = table(spark, d, "events").select("event_id", "event_type", "user_id", (F.col("event_id") % 50).alias("tokens"))
    return answers.usage(calls, ["event_type", "user_id"], "event_id", "tokens").select("event_id", "tokens_by_event_type", "tokens_by_user_id")


@query("""SELECT doc_id, part, CAST(strlen(v) AS INTEGER) AS n_bytes, CAST(greatest(1, (length(v) + 3) // 4) AS INTEGER) AS n_tokens FROM (SELECT doc_id, 'text' AS part, coalesce(text, '') AS v FROM documents UNION ALL SELECT doc_id, 'source', coalesce(source, '') FROM documents)""")
def payload_accounting(spark, d):
    return answers.payload(table(spark, d, "documents"), "doc_id", ["text", "source"])


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_suppkey <> 1) AS c, count(*) AS t FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n_cases, count(*) FILTER (c) AS n_covered, CAST(sum(t) AS BIGINT) AS n_tokens, count(*) = count(*) FILTER (c) AND sum(t) <= 1000000000 AS passed FROM f""")
def preflight_gate(spark, d):
    cases = sql(spark, d, "SELECT l_orderkey, array(true) AS expected, collect_set(l_suppkey <> 1) AS found, count(*) AS n_tokens FROM {lineitem} GROUP BY l_orderkey")
    return answers.gate(cases, 1_000_000_000)


@query("SELECT doc_id, CASE WHEN doc_id = 3 THEN 'corrected' ELSE lang END AS lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents UNION ALL SELECT 3) OR lang = 'fr'")
def label_correction(spark, d):
    cases = sql(spark, d, "SELECT doc_id, lang FROM {documents} WHERE doc_id = 3 OR lang = 'fr' OR doc_id = (SELECT min(doc_id) FROM {documents})")
    return answers.corrected(cases, spark.sql("SELECT 3L AS doc_id, 'corrected' AS lang"), "doc_id", "lang")


# --- refresh --------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 9 <> 0), c AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 4 <> 0)
SELECT sha, CASE WHEN c.sha IS NULL THEN 'missing' WHEN t.sha IS NULL THEN 'orphaned' ELSE 'reusable' END AS state FROM t FULL JOIN c USING (sha)""")
def embedding_states(spark, d):
    x = sql(spark, d, "SELECT doc_id, sha2(coalesce(text, ''), 256) AS sha FROM {documents}")
    return refresh.delta(x.where("doc_id % 9 <> 0"), x.where("doc_id % 4 <> 0"))


@query("""SELECT sha, CAST(64 AS INTEGER) AS dimension, state = 'old' AS from_cache FROM (SELECT sha256(coalesce(text, '')) AS sha, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'old' ELSE 'new' END AS state FROM documents GROUP BY coalesce(text, ''))""")
def embedding_refresh(spark, d):
    x = sql(spark, d, "SELECT doc_id, coalesce(text, '') AS text, sha2(coalesce(text, ''), 256) AS sha FROM {documents}")
    cache = x.where("doc_id % 3 = 0").select("sha").distinct().withColumn("embedding", F.array_repeat(F.lit(9.0).cast("float"), 64))
    out = refresh.embedded(x, cache, refresh.hashed_embedder(64))
    return out.select("sha", F.size("embedding").alias("dimension"), (F.get("embedding", F.lit(0)) == 9).alias("from_cache"))


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS is_representative FROM documents")
def representatives(spark, d):
    x = sql(spark, d, "SELECT doc_id, sha2(coalesce(text, ''), 256) AS sha FROM {documents}")
    return refresh.representatives(x, "doc_id", "sha").select("doc_id", "is_representative")


@query("""WITH m AS (SELECT l_orderkey AS block, min(l_suppkey) < max(l_suppkey) AS many FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS req, CASE WHEN coalesce(many, false) THEN 'section:unassigned' ELSE CAST(o_custkey AS VARCHAR) END AS section, coalesce(many, false) AS quarantined FROM orders LEFT JOIN m ON block = o_orderkey""")
def mixed_span_quarantine(spark, d):
    reqs = sql(spark, d, "SELECT o_orderkey AS req, o_orderkey AS block, CAST(o_custkey AS STRING) AS section FROM {orders}")
    return refresh.mixed_owners(reqs, sql(spark, d, "SELECT l_orderkey AS block, l_suppkey AS section FROM {lineitem}")).select("req", "section", "quarantined")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)) WHERE n <= 2""")
def batch_requirements(spark, d):
    keys = sql(spark, d, "SELECT c_custkey AS o_custkey FROM {customer} WHERE c_nationkey < 5")
    return refresh.first_per_key(table(spark, d, "orders"), keys, "o_custkey", ["o_orderkey"], 2).select("o_custkey", "o_orderkey")


# --- boxes and pages ------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_custkey AS id, o_orderkey AS page, o_orderkey + o_custkey % 4 AS last FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT l_orderkey AS page_no, l_linenumber AS line FROM lineitem WHERE l_linenumber > 4)
SELECT id, page, count(*) AS n FROM l JOIN f ON page_no BETWEEN page AND last GROUP BY id, page""")
def page_range_lookup(spark, d):
    ranges = sql(spark, d, "SELECT o_custkey AS id, o_orderkey AS page, o_orderkey + o_custkey % 4 AS last FROM {orders} WHERE o_orderkey % 3 = 0")
    lines = sql(spark, d, "SELECT l_orderkey AS page_no, l_orderkey AS page_end, l_linenumber AS line FROM {lineitem} WHERE l_linenumber > 4")
    return joins.overlapping(ranges, lines, [], ("page", "last"), ("page_no", "page_end"), 4).groupBy("id", "page").agg(F.count(F.lit(1)).alias("n"))


_TEXT_BOXES = "SELECT o_orderkey AS id, o_custkey AS page, o_orderkey % 50 AS lo, o_orderkey % 50 + 15 AS hi, o_orderkey % 7 * 10 AS top, o_orderkey % 7 * 10 + 25 AS bottom, o_orderpriority AS t FROM {orders}"


@query(f"""WITH b AS ({_TEXT_BOXES.format(orders='orders')})
SELECT a.id, string_agg(b.t, ' ' ORDER BY b.lo, b.id) AS texts FROM b a JOIN b ON a.page = b.page AND a.lo <= b.hi AND b.lo <= a.hi AND a.top <= b.bottom AND b.top <= a.bottom GROUP BY a.id""")
def box_texts(spark, d):
    """The texts of all boxes that each box meets on its page; one box's texts are as many as lie on its page."""
    b = sql(spark, d, _TEXT_BOXES)
    inner = b.select("page", F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("lo", "top", "hi", "bottom")], "t")
    met = joins.overlapping_boxes(b.drop("t"), inner, ["page"], ("lo", "top", "hi", "bottom"), ("o_lo", "o_top", "o_hi", "o_bottom"), 30, 30)
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_lo", "other", "t"))), lambda x: x["t"]), " ").alias("texts"))


@query("""SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY o_orderkey) AS row_text FROM orders GROUP BY o_custkey""")
def ordered_rows(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["o_orderpriority"]), " | ").alias("row_text"))


@query("""SELECT c_custkey, a AS ancestor, CAST(i AS INTEGER) AS level FROM (SELECT c_custkey, unnest(string_split(300 + c_nationkey || '/' || c_custkey % 13 || '/' || c_custkey, '/')) AS a, generate_subscripts(string_split(300 + c_nationkey || '/' || c_custkey % 13 || '/' || c_custkey, '/'), 1) AS i FROM customer)""")
def ancestors_from_path(spark, d):
    path = F.concat_ws("/", (300 + F.col("c_nationkey")).cast("string"), (F.col("c_custkey") % 13).cast("string"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.posexplode(F.split(path, "/")).alias("i", "ancestor")).select("c_custkey", "ancestor", (F.col("i") + 1).alias("level"))


@query("""SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: contains(lower(w), 'r'))) > 0""")
def any_cell(spark, d):
    return table(spark, d, "part").where(F.exists(F.split("p_name", " "), lambda w: F.contains(F.lower(w), F.lit("r")))).select("p_partkey", "p_name")


# --- search and sketches ------------------------------------------------------------------------------------------------------


@query(ORACLE["rrf_fused_topk"])
def hybrid_search(spark, d):
    """The named operation, with an embedder that knows one vector: it answers as the fused rankings do."""
    vectors = table(spark, d, "embeddings")
    known = [float(x) for x in vectors.where("vec_id = 0").select("embedding").first()[0]]
    return Tools(spark, table(spark, d, "documents"), vectors, lambda texts: [known for _ in texts]).execute("hybrid_search", {"query": "the and attion to thanedble", "top_k": 10})


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, true AS parts_near, true AS suppliers_near, true AS median_near FROM lineitem GROUP BY l_returnflag")
def sketch_estimates(spark, d):
    """Sketches merge across tasks, so counts and quantiles need no shuffle of values. Beside exact counts: whether each lies within a tenth."""
    lines = table(spark, d, "lineitem")
    near = lambda a, b: F.abs(a - b) <= 0.1 * b
    told = lines.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"), F.approx_count_distinct("l_suppkey", 0.02).alias("approx"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"), F.avg("l_quantity").alias("mean"))
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))
    return told.join(exact, "l_returnflag").select("l_returnflag", "n_parts", "n_suppliers", near(F.col("hll"), F.col("n_parts")).alias("parts_near"), near(F.col("approx"), F.col("n_suppliers")).alias("suppliers_near"), near(F.col("median"), F.col("mean")).alias("median_near"))
