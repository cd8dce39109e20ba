"""Relational query shapes as SQL that both engines read alike.

{name} stands for a table. The hierarchy is region > nation > customer > orders > lineitem; suppliers are linked to
parts by lineitem, whose flags are the link's properties. Branches of an optional pattern are aggregated before
they are joined, so no pattern multiplies its branches; lists are sorted, so results do not hang on order.
"""

from __future__ import annotations

SHARED: dict[str, str] = {}

SHARED["scan_project_filter"] = """
SELECT d.doc_id, d.lang, d.source, d.n_chars FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars IS NOT NULL AND d.lang IN ('en', 'fr')"""
SHARED["point_lookup"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey = 77"
SHARED["children_of"] = "SELECT n_nationkey, n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"
SHARED["chapter_children_at_level"] = """
SELECT r.r_name, c.c_custkey FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey
WHERE c.c_mktsegment = 'BUILDING'"""
SHARED["edge_join_prohibited"] = """
SELECT DISTINCT s.s_name AS source, p.p_type AS target, l.l_returnflag AS flag FROM {supplier} s JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey
JOIN {part} p ON p.p_partkey = l.l_partkey WHERE l.l_returnflag = 'R' AND p.p_size > 40"""
SHARED["edge_reverse"] = """
SELECT p.p_partkey AS target, count(DISTINCT l.l_suppkey) AS n_sources FROM {part} p JOIN {lineitem} l ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag = 'R' AND p.p_brand = 'Brand#2' GROUP BY p.p_partkey"""
SHARED["polymorphic_target"] = """
SELECT o.o_orderkey, coalesce(c.c_name, s.s_name) AS target, CASE WHEN c.c_name IS NOT NULL THEN 'Customer' WHEN s.s_name IS NOT NULL THEN 'Supplier' END AS label
FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' LEFT JOIN {supplier} s ON s.s_suppkey = o.o_custkey WHERE o.o_orderstatus = 'P'"""
SHARED["titled_reference"] = """
SELECT l.l_orderkey, l.l_linenumber, concat(o.o_orderpriority, ' of ', c.c_name) AS reference FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE l.l_linenumber = 7"""
SHARED["two_hop_pattern"] = """
SELECT DISTINCT a.l_suppkey FROM {lineitem} a JOIN {lineitem} b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_quantity > 40"""
SHARED["keyword_theta"] = "SELECT s_suppkey, n_nationkey FROM {supplier} JOIN {nation} ON s_name LIKE concat('%', n_nationkey, '%')"
SHARED["title_keyword_or"] = "SELECT p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%red%'"
SHARED["search_needle"] = "SELECT s_suppkey, s_name FROM {supplier} WHERE lower(concat(CAST(s_suppkey AS STRING), ' ', s_name)) LIKE '%7%'"
SHARED["multiway_optional"] = """
WITH o AS (SELECT o_custkey, count(*) AS n_orders, count(DISTINCT o_orderpriority) AS n_priorities FROM {orders} GROUP BY o_custkey),
l AS (SELECT o_custkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey),
e AS (SELECT user_id, count(*) AS n_events FROM {events} GROUP BY user_id)
SELECT c.c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_priorities, 0) AS n_priorities, coalesce(n_lines, 0) AS n_lines, coalesce(n_parts, 0) AS n_parts, coalesce(n_events, 0) AS n_events
FROM {customer} c LEFT JOIN o ON o.o_custkey = c.c_custkey LEFT JOIN l ON l.o_custkey = c.c_custkey LEFT JOIN e ON e.user_id = c.c_custkey"""
SHARED["full_outer_coalesce"] = """
WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey),
s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey)
SELECT coalesce(c.k, s.k) AS nationkey, n_customers, n_suppliers, CASE WHEN c.k IS NULL THEN 'supplier' WHEN s.k IS NULL THEN 'customer' ELSE 'both' END AS found
FROM c FULL OUTER JOIN s ON c.k = s.k"""
SHARED["permitted_prohibited"] = """
SELECT s_suppkey, status, count(*) AS n FROM (
  SELECT l_suppkey AS s_suppkey, 'permitted' AS status FROM {lineitem} WHERE l_returnflag = 'A' UNION ALL
  SELECT l_suppkey, 'prohibited' FROM {lineitem} WHERE l_returnflag = 'R') x GROUP BY s_suppkey, status"""
SHARED["semi_anti_hash_delta"] = """
SELECT doc_id, 'reusable' AS state FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id) UNION ALL
SELECT doc_id, 'missing' FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id) UNION ALL
SELECT doc_id, 'orphaned' FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id)"""
SHARED["endpoint_integrity"] = """
SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey)
OR NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0)"""
SHARED["set_operations"] = """
SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) a UNION ALL
SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) b UNION ALL
SELECT k, 'suppliers' FROM (SELECT s_nationkey AS k FROM {supplier} EXCEPT SELECT c_nationkey FROM {customer}) c"""
SHARED["universal_coverage"] = """
WITH t AS (SELECT count(*) AS total FROM {nation}),
p AS (SELECT p.p_brand, count(DISTINCT s.s_nationkey) AS n_nations FROM {part} p JOIN {lineitem} l ON l.l_partkey = p.p_partkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY p.p_brand)
SELECT p_brand, n_nations, CASE WHEN n_nations = total THEN 'universal' ELSE 'selective' END AS coverage FROM p CROSS JOIN t"""
SHARED["relational_division"] = """
SELECT l.l_suppkey FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY l.l_suppkey
HAVING count(DISTINCT p.p_type) = (SELECT count(DISTINCT p_type) FROM {part})"""
SHARED["share_at_least_half"] = """
WITH t AS (SELECT count(DISTINCT p_brand) AS total FROM {part}),
p AS (SELECT p_type, count(DISTINCT p_brand) AS n FROM {part} GROUP BY p_type)
SELECT p_type, n, round(CAST(100 AS DOUBLE) * n / total, 4) AS percent FROM p CROSS JOIN t WHERE n * 2 >= total"""
SHARED["avg_distinct_round"] = """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 2) AS avg_quantity, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers
FROM {lineitem} GROUP BY l_returnflag, l_linestatus"""
SHARED["label_counts"] = """
SELECT label, count(*) AS n FROM (SELECT 'Region' AS label FROM {region} UNION ALL SELECT 'Nation' FROM {nation} UNION ALL SELECT 'Customer' FROM {customer} UNION ALL SELECT 'Order' FROM {orders}) x GROUP BY label"""
SHARED["conditional_counts"] = """
SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS n_both FROM {labels}"""
SHARED["coverage_ratios"] = """
SELECT d.source, count(*) AS n, count(l.doc_id) AS n_labelled, CASE WHEN count(l.doc_id) = 0 THEN 1.0 ELSE round(CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(l.doc_id), 6) END AS good_ratio
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.source"""
SHARED["category_summary"] = """
WITH dim AS (SELECT * FROM (VALUES ('0', 'tiny'), ('1', 'short'), ('2', 'long'), ('9', 'huge')) AS v(code, category)),
x AS (SELECT CASE WHEN n_chars < 200 THEN '0' WHEN n_chars < 2000 THEN '1' WHEN n_chars < 100000000 THEN '2' ELSE '9' END AS code, doc_id, source FROM {documents})
SELECT dim.category, count(x.doc_id) AS n, count(DISTINCT x.source) AS n_sources, min(x.doc_id) AS first_id, max(x.doc_id) AS last_id FROM dim LEFT JOIN x ON x.code = dim.code GROUP BY dim.category"""
SHARED["duplicate_keys"] = "SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type HAVING count(*) > 20"
SHARED["exact_token_cost"] = """
SELECT lang, CAST(sum(greatest(1, CAST(floor((n_chars + 3) / 4.0) AS BIGINT))) AS BIGINT) AS n_tokens,
round(CAST(sum(greatest(1, CAST(floor((n_chars + 3) / 4.0) AS BIGINT))) AS BIGINT) / 1e6 * 0.13, 9) AS cost FROM {documents} GROUP BY lang"""
SHARED["cube_rollup_sets"] = """
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS no_flag FROM {lineitem}
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linenumber), ())"""
SHARED["rollup_counts"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"
SHARED["cube_counts"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"
SHARED["hit_rates"] = """
WITH r AS (SELECT l_suppkey AS q, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rn, l_returnflag FROM {lineitem}),
h AS (SELECT q, max(CASE WHEN rn = 1 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit1, max(CASE WHEN rn <= 5 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit5 FROM r GROUP BY q)
SELECT count(*) AS questions, CAST(sum(hit1) AS BIGINT) AS hits1, CAST(sum(hit5) AS BIGINT) AS hits5, round(avg(hit1), 6) AS rate1, round(avg(hit5), 6) AS rate5 FROM h"""
SHARED["topk_per_group"] = """
SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) x WHERE rn <= 3"""
SHARED["topk_then_cap"] = """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) x WHERE rn <= 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"""
SHARED["ranking_functions"] = """
SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr,
CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS quartile, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr FROM {part}"""
SHARED["next_start_offsets"] = """
SELECT l_orderkey, l_linenumber, n_start, coalesce(lead(n_start) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, n_start), 1000) AS n_end
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber * 100 AS n_start FROM {lineitem}) x"""
SHARED["page_gap_check"] = """
SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 500 AS gap FROM {events}"""
SHARED["repeated_header_removal"] = """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS row_index FROM (
  SELECT user_id, event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS header, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) x
WHERE n = 1 OR event_type <> header"""
SHARED["new_vs_existing_evidence"] = """
SELECT conv_id, turn, role, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id, role) THEN 'new' ELSE 'existing' END AS state FROM {conversations}"""
SHARED["priority_union"] = """
SELECT k, src, v FROM (SELECT k, src, v, row_number() OVER (PARTITION BY k ORDER BY pri DESC) AS rn FROM (
  SELECT c_custkey AS k, 1 AS pri, 'historical' AS src, c_name AS v FROM {customer} UNION ALL
  SELECT s_suppkey, 2, 'checkpoint', s_name FROM {supplier}) u) x WHERE rn = 1"""
SHARED["mode_first_seen"] = """
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS rn FROM (
  SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM {events} GROUP BY user_id, event_type) g) x WHERE rn = 1"""
SHARED["dedupe_min_id"] = """
SELECT min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT lang) AS n_langs, count(DISTINCT lang) > 1 AS conflict FROM {documents} GROUP BY text HAVING count(*) > 1"""
SHARED["requirement_top_n_per_key"] = """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {lineitem}) x WHERE rn <= 2"""
SHARED["tpch_pricing_summary"] = """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_base_price, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
SHARED["tpch_region_revenue"] = """
SELECT n.n_name, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2)) * (CAST(1 AS DECIMAL(18, 2)) - CAST(l.l_discount AS DECIMAL(18, 2)))) AS DOUBLE) AS revenue
FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey
JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name"""
SHARED["requirement_exists_any"] = "SELECT o_orderkey FROM {orders} o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)"
SHARED["distinct_dimension"] = "SELECT DISTINCT p_type FROM {part}"
SHARED["embedding_missing"] = "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {embeddings} e ON e.vec_id = d.doc_id"
SHARED["embedding_delta"] = """
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN o.k <> n.k THEN 'changed' ELSE 'same' END AS change FROM
(SELECT doc_id, md5(coalesce(text, '')) AS k FROM {documents}) n LEFT JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '.') ELSE coalesce(text, '') END) AS k FROM {documents} WHERE doc_id % 5 <> 0) o ON o.doc_id = n.doc_id"""
SHARED["keyed_upsert"] = """
WITH old AS (SELECT s_suppkey AS k, s_name AS v FROM {supplier} WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS k, concat(s_name, '!') AS v FROM {supplier} WHERE s_suppkey % 2 = 0)
SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k = old.k)"""
SHARED["edge_upsert"] = """
WITH old AS (SELECT l_suppkey AS src, l_partkey AS dst, max(l_quantity) AS qty FROM {lineitem} WHERE l_linenumber < 4 GROUP BY l_suppkey, l_partkey),
asked AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN max(l_linenumber) = 5 THEN NULL ELSE max(l_quantity) + 100 END AS qty FROM {lineitem} WHERE l_linenumber > 2 GROUP BY l_suppkey, l_partkey),
new AS (SELECT a.src, a.dst, a.qty FROM asked a JOIN {supplier} s ON s.s_suppkey = a.src JOIN {part} p ON p.p_partkey = a.dst)
SELECT coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, coalesce(n.qty, o.qty) AS qty, CASE WHEN o.src IS NULL THEN 'created' WHEN n.src IS NULL THEN 'kept' ELSE 'merged' END AS change
FROM new n FULL OUTER JOIN old o ON n.src = o.src AND n.dst = o.dst"""
SHARED["range_frames"] = """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS around FROM {events}"""
SHARED["path_prefix"] = "SELECT o_orderkey, concat('/', o_custkey, '/', o_orderkey) AS path FROM {orders} WHERE concat('/', o_custkey, '/', o_orderkey) LIKE '/1/%' OR concat('/', o_custkey, '/', o_orderkey) LIKE '/7/%'"
SHARED["caption_search"] = "SELECT p_partkey, p_name, p_type FROM {part} WHERE lower(concat(p_name, ' ', p_type)) LIKE '%steel%' OR lower(concat(p_name, ' ', p_type)) LIKE '%ring%'"
SHARED["section_vs_table"] = """
SELECT n_name, count(DISTINCT c_custkey) AS n_rows, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS n_above, min(c_acctbal) AS least, max(c_acctbal) AS most
FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name"""
SHARED["breakdown_checked"] = """
SELECT source, lang, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 4) AS percent FROM (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang) x"""
SHARED["duplicate_geometry"] = """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id, event_type) AS BIGINT) AS same_text, CAST(count(*) OVER (PARTITION BY user_id, event_type, floor(value)) AS BIGINT) AS same_place FROM {events}"""
SHARED["candidate_choice"] = """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS rn FROM {events}) x WHERE rn = 1"""
SHARED["referenced_tables"] = """
SELECT DISTINCT o.o_orderkey, l.l_partkey FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P'"""
SHARED["split_disjoint"] = """
SELECT count(*) AS n_shared FROM (SELECT doc_id FROM {labels} WHERE doc_id % 7 < 2 INTERSECT SELECT doc_id FROM {labels} WHERE doc_id % 7 >= 2) x"""
SHARED["set_equality"] = """
SELECT c_nationkey, count(*) AS n_customers, count(s_nationkey) AS n_with_supplier, count(*) = count(s_nationkey) AS is_subset FROM {customer} LEFT JOIN (SELECT DISTINCT s_nationkey FROM {supplier}) s ON s_nationkey = c_nationkey GROUP BY c_nationkey"""
SHARED["graph_snapshot"] = """
SELECT kind, name, n FROM (SELECT 'node' AS kind, 'Supplier' AS name, count(*) AS n FROM {supplier} UNION ALL SELECT 'node', 'Part', count(*) FROM {part} UNION ALL
SELECT 'edge', 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) a UNION ALL SELECT 'edge', 'CONTAINS', count(*) FROM {orders} UNION ALL
SELECT 'unique', 'Supplier', count(DISTINCT s_suppkey) FROM {supplier}) x"""
SHARED["conversation_disagreement"] = """
SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, CAST(max(length(text)) AS BIGINT) AS longest FROM {conversations} GROUP BY conv_id HAVING count(*) > 1"""


def for_duckdb(text: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text).replace("LEFT ANTI JOIN", "ANTI JOIN")
