"""Queries of the record operators, over rows that are made of the tables by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import rules
from skarn.functions.text import unicode_tokens
from skarn.functions.vocabulary import nfkc
from skarn.operators import audit, evidence, records, refresh, retrieval
from skarn.plans.queries import query
from skarn.sources import files, guard, pages
from skarn.sources.shared import place
from skarn.sources.tables import sql, table
from skarn.streaming import events as stream


def choose(key: str, options: list[str]) -> str:
    """SQL: one of the options, which are SQL themselves, by key modulo their number."""
    return f"CASE ({key}) % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def plain(text: str) -> str:
    """The same SQL for DuckDB: table names without braces."""
    return text.replace("{", "").replace("}", "")


# --- pages ----------------------------------------------------------------------------------------------------------

_PAGE_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, CAST(i // 50 + 1 AS INTEGER) AS page_no, CAST(i % 50 AS INTEGER) AS line_index, text FROM l)"""


def _lines(spark, d):
    return pages.laid_out(table(spark, d, "documents"))


@query(f"""WITH {_PAGE_LINES} SELECT doc_id, page_no, line_index, text, CAST(40 + line_index * 14 AS DOUBLE) AS top, CAST(40 + length(text) * 6 AS DOUBLE) AS "right", CASE WHEN regexp_matches(text, '^\\s*(#|\\d{{3,4}}(\\.\\d+)*\\s+[A-Z])') THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS max_font_size FROM p""")
def page_lines(spark, d):
    return _lines(spark, d).select("doc_id", "page_no", "line_index", "text", "top", "right", "max_font_size")


@query(f"WITH {_PAGE_LINES} SELECT doc_id, page_no, sha256(string_agg(text, chr(10) ORDER BY line_index)) AS sha FROM p GROUP BY doc_id, page_no")
def page_text_scan(spark, d):
    return pages.page_texts(_lines(spark, d)).select("doc_id", "page_no", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_PAGE_LINES}, t AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_index) AS text FROM p GROUP BY ALL) SELECT doc_id, sha256(string_agg(text, chr(12) ORDER BY page_no)) AS sha FROM t GROUP BY doc_id")
def document_text_scan(spark, d):
    return pages.document_texts(pages.page_texts(_lines(spark, d))).select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_PAGE_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_index) AS text FROM p WHERE page_no = 2 GROUP BY doc_id")
def single_page(spark, d):
    return pages.one_page(_lines(spark, d), 2)


@query(f"""WITH {_PAGE_LINES}, g AS (SELECT doc_id, page_no, count(*) AS n_lines, CAST(max(40 + length(text) * 6) AS DOUBLE) AS "right" FROM p GROUP BY ALL)
SELECT doc_id, page_no, n_lines, "right", CAST(coalesce(sum(n_lines) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g""")
def page_index(spark, d):
    return pages.page_index(_lines(spark, d)).select("doc_id", "page_no", "n_lines", "right", "before")


_NAV = "SELECT o_orderkey AS id, " + choose("o_orderkey", ["CAST(o_custkey AS STRING)", "concat('Page ', o_custkey)", "'INDEX'", "concat('go  to ', o_orderpriority)", "concat('See item ', o_custkey)", "'contents'", "concat(o_custkey, '.')"]) + " AS text, CAST(o_custkey % 9 * 100 AS DOUBLE) AS top, CAST(o_custkey % 9 * 100 + 12 AS DOUBLE) AS bottom FROM {orders}"


@query(f"""SELECT id, (top <= 55 OR bottom >= 737) AND regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)^\\d{{1,4}}\\.?$|\\b(contents|table\\s+of\\s+contents|index|go\\s+to|previous|next|page\\s+\\d+)\\b') AS is_navigation FROM ({plain(_NAV)})""".replace("AS STRING", "AS VARCHAR"))
def navigation_evidence(spark, d):
    return sql(spark, d, _NAV).select("id", audit.navigation(F.col("text"), F.col("top"), F.col("bottom")).alias("is_navigation"))


# --- evidence -------------------------------------------------------------------------------------------------------

_BLOCKS = (
    "SELECT o_orderkey AS block_id, " + choose("o_orderkey", ["'NormativeSectionContent'", "'Insights'", "'ExceptionText'", "NULL", "'UserNote'"]) + " AS content_class, "
    + choose("o_custkey", ["'paragraph'", "'exception'", "'table_ref'", "'unparsed'"]) + " AS block_type, "
    + choose("o_orderkey + o_custkey", ["concat('[BS] Ducts of ', o_custkey, ' shall be kept')", "concat('Exception: ', o_orderkey)", "' '", "concat('INSIGHTS for ', o_custkey)", "', provided it is dry'", "'exception:'", "concat('Vents ', o_orderkey)"])
    + " AS text, " + choose("o_custkey", ["NULL", "concat('Exception: all of ', o_custkey, ' in full')", "NULL"]) + " AS fallback FROM {orders}"
)


@query(f"""WITH b AS (SELECT block_id, lower(coalesce(content_class, '')) AS c, block_type AS t, trim(text) AS x, fallback FROM ({plain(_BLOCKS)})),
k AS (SELECT block_id, CASE WHEN (t = 'exception' OR c LIKE 'exception%') AND length(x) < length(fallback) THEN fallback ELSE x END AS x FROM b WHERE x <> '' AND c NOT IN ('insights', 'commentary', 'usernote', 'sourcenavigation', 'sourceartifact') AND NOT contains(lower(x), 'insights')
  AND NOT (t = 'table_ref' AND NOT c LIKE 'exception%') AND NOT (t = 'unparsed' AND fallback IS NOT NULL AND (lower(x) LIKE 'exception%' OR x LIKE ',%' OR x LIKE 'provided%')))
SELECT block_id, trim(regexp_replace(x, '^\\[(BS|BF)\\]\\s*', '')) AS text FROM k WHERE lower(x) NOT IN ('exception:', '[bs]', '[bf]')""")
def allowed_evidence(spark, d):
    blocks = sql(spark, d, _BLOCKS).withColumn("number", F.lit("no number")).withColumn("others", F.array(F.lit("no other")))
    return records.allowed_evidence(blocks)


@query("""SELECT 'E' || o_orderkey AS evidence_id, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE '3' || o_custkey END AS section_number, coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END, '') AS section_title, trim(CASE WHEN o_orderkey % 4 = 0 THEN ' x ' ELSE o_orderstatus END) AS source_text FROM orders WHERE o_custkey % 7 > 0 AND o_orderkey % 11 > 0""")
def compact_evidence(spark, d):
    blocks = sql(spark, d, """SELECT concat('E', o_orderkey) AS evidence_id, CASE WHEN o_custkey % 7 = 0 THEN 'unassigned' WHEN o_custkey % 5 > 0 THEN concat('3', o_custkey) END AS section_number, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS section_title, 1 AS page,
      CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 4 = 0 THEN ' x ' ELSE o_orderstatus END AS source_text FROM {orders}""")
    return records.compact_evidence(blocks).drop("page")


@query("""WITH b AS (SELECT l_orderkey AS section, l_orderkey * 10 + l_linenumber AS block_id, 'Q' || (l_partkey % 50) || '=av' AS k FROM lineitem), f AS (SELECT DISTINCT o_orderkey AS section, 'q' || (o_custkey % 50) || '=av' AS k FROM orders)
SELECT DISTINCT section, block_id FROM b WHERE lower(k) NOT IN (SELECT k FROM f) OR EXISTS (SELECT 1 FROM f WHERE f.section = b.section AND f.k = lower(b.k))""")
def foreign_formulas(spark, d):
    blocks = sql(spark, d, "SELECT l_orderkey AS section, l_orderkey * 10 + l_linenumber AS block_id, concat('Q', l_partkey % 50, ' = a V') AS text FROM {lineitem}")
    formulas = sql(spark, d, "SELECT o_orderkey AS section, concat('q', o_custkey % 50, '  =  A v') AS formula FROM {orders}")
    return records.without_foreign_formulas(blocks, formulas).select("section", "block_id").distinct()


@query("""SELECT o_orderkey AS section, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, arg_min(l_suppkey, l_linenumber) FILTER (l_partkey % 2 = 0)) AS page FROM orders LEFT JOIN (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def first_pages(spark, d):
    sections = sql(spark, d, "SELECT o_orderkey AS section, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS page FROM {orders}")
    lines = sql(spark, d, "SELECT l_orderkey AS section, l_linenumber AS ord, min(struct(l_partkey, l_suppkey)) AS x FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
    return records.first_pages(sections, lines.select("section", "ord", F.expr("CASE WHEN x.l_partkey % 2 = 0 THEN x.l_suppkey END").alias("page")))


@query("SELECT 'structural:' || s_suppkey AS retrieval_hash, CAST(s_acctbal AS DOUBLE) AS similarity, 'section:' || s_suppkey AS section_id, s_name AS title FROM supplier")
def candidate_shape(spark, d):
    hits = sql(spark, d, "SELECT CAST(s_suppkey AS STRING) AS number, s_name AS title, s_nationkey AS page, s_acctbal AS score FROM {supplier}")
    return records.candidates(hits).select("retrieval_hash", "similarity", F.col("section.id").alias("section_id"), F.col("section.title").alias("title"))


# --- blocks and provenance ------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey * 10 + l_linenumber AS item_id, l_linenumber AS page_no, CASE WHEN l_suppkey % 4 > 0 THEN CAST(least(l_quantity, l_partkey) AS DOUBLE) END AS top, CASE WHEN l_suppkey % 5 > 0 THEN l_partkey END AS char_start, sha256(l_returnflag) AS sha,
array_to_string(list_filter([CASE WHEN l_suppkey % 4 = 0 THEN 'bbox' END, CASE WHEN l_suppkey % 5 = 0 THEN 'charspan' END], lambda x: x IS NOT NULL), ',') AS missing FROM lineitem""")
def provenance_build(spark, d):
    items = sql(spark, d, "SELECT l_orderkey * 10 + l_linenumber AS item_id, l_linenumber AS page, CASE WHEN l_suppkey % 4 > 0 THEN 1D END AS l, CAST(l_quantity AS DOUBLE) AS t, 2D AS r, CAST(l_partkey AS DOUBLE) AS b, CASE WHEN l_suppkey % 5 > 0 THEN l_partkey END AS char_start, l_partkey + 5 AS char_end, l_returnflag AS text FROM {lineitem}")
    made = records.provenance(items)
    return made.select("item_id", F.col("provenance.page_no").alias("page_no"), F.col("provenance.bbox.top").alias("top"), F.col("provenance.charspan.char_start").alias("char_start"), F.col("provenance.text_sha256").alias("sha"), F.array_join("missing", ",").alias("missing"))


_ITEMS = "SELECT p_partkey AS item_id, " + choose("p_partkey", ["'text'", "'section_header'", "'list_item'", "'formula'", "'Footnote'"]) + " AS label, " + choose("p_size", ["p_name", "concat('Exceptions: ', p_name)", "''", "concat('USER NOTE ', p_name)"]) + " AS text FROM {part}"


@query(f"""SELECT 'block:' || substr(sha256(item_id || '|' || label), 1, 20) AS block_id, CASE WHEN text = '' THEN 'unparsed' WHEN text LIKE 'Exceptions:%' THEN 'exception' WHEN label = 'section_header' THEN 'heading' WHEN label = 'list_item' THEN 'list' WHEN label = 'formula' THEN 'equation' ELSE 'paragraph' END AS block_type,
CASE WHEN text LIKE 'USER NOTE%' THEN 'UserNote' WHEN label = 'Footnote' THEN 'Commentary' ELSE 'NormativeSectionContent' END AS content_class, CASE WHEN text = '' THEN 'no text' END AS reason FROM ({plain(_ITEMS)})""")
def content_blocks(spark, d):
    return records.content_blocks(sql(spark, d, _ITEMS)).drop("text")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)), p AS (SELECT c_custkey AS id, c_name AS text FROM customer WHERE c_custkey % 7 > 0), v AS (SELECT s_suppkey AS id, min(s_nationkey) AS page FROM supplier GROUP BY 1)
SELECT id, text, page, CASE WHEN text IS NULL THEN 'absent' WHEN page IS NULL THEN 'no provenance' ELSE 'attached' END AS status FROM a LEFT JOIN p USING (id) LEFT JOIN v USING (id)""")
def reattached_blocks(spark, d):
    c = table(spark, d, "customer")
    document, preserved = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")), c.where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return records.reattached(document, preserved, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("page")))


@query("""SELECT o_custkey AS page, CAST(count(*) AS INTEGER) AS n, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders WHERE o_orderkey % 6 > 0 GROUP BY o_custkey""")
def texts_by_page(spark, d):
    return records.texts_by_page(sql(spark, d, "SELECT o_custkey AS page, o_orderkey AS ord, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority ELSE ' ' END AS text FROM {orders}"))


@query("""SELECT l_orderkey AS page, min(l_linenumber) AS "left", min(l_quantity) AS top, max(l_linenumber + 5) AS "right", max(l_quantity + 3) AS bottom, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS table_ids FROM lineitem GROUP BY l_orderkey""")
def table_regions(spark, d):
    t = sql(spark, d, "SELECT l_orderkey AS page, l_partkey AS table_id, l_linenumber AS `left`, l_quantity AS top, l_linenumber + 5 AS `right`, l_quantity + 3 AS bottom FROM {lineitem}")
    return records.regions(t).select("page", "region.*", F.array_join(F.transform("table_ids", lambda x: x.cast("string")), ",").alias("table_ids"))


_NUMBERS = "SELECT p_partkey AS id, " + choose("p_partkey", ["concat(300 + p_size, '.', p_partkey)", "concat(300 + p_size)", "concat('A', p_size)", "concat(300 + p_size, '.', p_partkey, '.2')", "NULL"]) + " AS number, p_name AS title FROM {part}"


@query(f"SELECT number, title, CASE WHEN contains(number, '.') THEN array_to_string(string_split(number, '.')[:-2], '.') END AS parent FROM ({plain(_NUMBERS)}) WHERE regexp_full_match(number, '\\d{{3,4}}(\\.\\d+)*')")
def numbered_sections(spark, d):
    return records.numbered(sql(spark, d, _NUMBERS))


# --- reconciliation -------------------------------------------------------------------------------------------------

_KINDS = {  # eleven kinds of target, of the tables that stand for them
    "chapter": "SELECT r_regionkey AS target_id, NULL AS section, r_regionkey AS ord, r_name AS text FROM {region}",
    "section": "SELECT n_nationkey AS target_id, n_regionkey AS section, n_nationkey AS ord, n_name AS text FROM {nation}",
    "block": "SELECT c_custkey AS target_id, c_nationkey AS section, c_custkey AS ord, c_name AS text FROM {customer}",
    "exception": "SELECT c_custkey AS target_id, c_nationkey AS section, c_custkey AS ord, CASE WHEN c_acctbal < 0 THEN concat('Exception: ', c_mktsegment) END AS text FROM {customer}",
    "table": "SELECT s_suppkey AS target_id, s_nationkey AS section, s_suppkey AS ord, s_name AS text FROM {supplier}",
    "table_row": "SELECT l_orderkey * 10 + l_linenumber AS target_id, l_suppkey AS section, l_linenumber AS ord, concat(l_returnflag, ' | ', l_linestatus) AS text FROM {lineitem}",
    "footnote": "SELECT o_orderkey AS target_id, o_custkey AS section, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN concat('a. ', o_orderpriority) ELSE ' ' END AS text FROM {orders}",
    "equation": "SELECT p_partkey AS target_id, NULL AS section, p_partkey AS ord, CASE WHEN p_size > 40 THEN concat('Q', p_size, ' = ', p_partkey) END AS text FROM {part}",
    "reference": "SELECT item_id AS target_id, NULL AS section, item_id AS ord, text FROM {benchmark}",
    "hyperlink": "SELECT page_id AS target_id, NULL AS section, page_id AS ord, url AS text FROM {pages}",
    "unparsed": "SELECT CASE WHEN doc_id % 5 > 0 THEN doc_id END AS target_id, source AS section, doc_id AS ord, lang AS text FROM {documents}",
}


@query("SELECT kind, count(*) AS n, CAST(sum(ord) AS BIGINT) AS ords, count(section) AS with_section, CAST(sum(length(text)) AS BIGINT) AS chars FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(target_id AS VARCHAR) AS target_id, CAST(section AS VARCHAR) AS section, ord, text FROM ({plain(t)}) AS t" for k, t in _KINDS.items()) + ") WHERE target_id IS NOT NULL AND length(trim(text)) > 0 GROUP BY kind")
def reconciliation_targets(spark, d):
    every = records.targets({k: sql(spark, d, t) for k, t in _KINDS.items()})
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"), F.count("section").alias("with_section"), F.sum(F.length("text")).alias("chars"))


_CLASSIFIED = """c AS (SELECT o_orderkey AS line_id, o_orderpriority AS category, CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 4 = 0 THEN 'matched_with_residual' WHEN o_custkey % 3 > 0 THEN 'matched' WHEN o_orderstatus <> 'F' THEN 'excluded' ELSE 'unmatched' END AS classification FROM orders)"""


def _classified(spark, d):
    lines = sql(spark, d, "SELECT o_orderkey AS line_id, o_orderpriority AS category, o_orderstatus = 'F' AS blocker FROM {orders}")
    return records.reconciled(lines, sql(spark, d, "SELECT o_orderkey AS line_id FROM {orders} WHERE o_custkey % 3 > 0"), sql(spark, d, "SELECT o_orderkey AS line_id FROM {orders} WHERE o_orderkey % 4 = 0"))


@query(f"WITH {_CLASSIFIED} SELECT * FROM c")
def line_classification(spark, d):
    return _classified(spark, d)


@query(f"""WITH {_CLASSIFIED}, n AS (SELECT count(*) AS n_lines, count(*) FILTER (classification = 'unmatched') AS n_unmatched, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_orphans, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(DISTINCT lang) > 1)) AS n_conflicts FROM c)
SELECT *, CASE WHEN n_unmatched + n_orphans + n_conflicts = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM n""")
def reconciliation_verdict(spark, d):
    orphans = sql(spark, d, "SELECT l_orderkey FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey)")
    conflicts = sql(spark, d, "SELECT text FROM {documents} GROUP BY text HAVING count(DISTINCT lang) > 1")
    return records.verdict(_classified(spark, d), orphans, conflicts)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS "case", l_suppkey AS r FROM lineitem) SELECT "case", count(*) AS n, count(*) FILTER (s_acctbal < 2000) AS n_quarantined, CASE WHEN count(*) FILTER (s_acctbal < 2000) = 0 THEN 'none' WHEN count(*) FILTER (s_acctbal < 2000) < count(*) THEN 'partly' ELSE 'only' END AS depends FROM e LEFT JOIN supplier ON s_suppkey = r GROUP BY "case" """)
def evidence_dependencies(spark, d):
    used = sql(spark, d, "SELECT l_orderkey AS case, l_suppkey AS requirement FROM {lineitem}")
    return records.dependencies(used, sql(spark, d, "SELECT s_suppkey AS requirement FROM {supplier} WHERE s_acctbal < 2000"))


@query("""SELECT 'nation' AS name, count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_keys, count(*) = count(DISTINCT n_nationkey) AS ok FROM nation UNION ALL SELECT 'region of nation', count(*), count(DISTINCT n_regionkey), count(*) = count(DISTINCT n_regionkey) FROM nation
UNION ALL SELECT 'line', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def unique_constraints(spark, d):
    nation = table(spark, d, "nation")
    return records.unique_violations({"nation": (nation, ["n_nationkey"]), "region of nation": (nation, ["n_regionkey"]), "line": (table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])})


# --- JSON -----------------------------------------------------------------------------------------------------------

_JSON = """concat('{"section_number": "', 300 + o_custkey % 50, '.', o_orderkey % 9, '", "rows": [{"id": "section:', 400 + o_orderkey % 30, '", "n": ', o_custkey, '}, {"id": "other:', o_custkey, '", "inner": {"number": "', CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '505' END, '", "none": null}}], "ok": true}')"""


@query(f"""SELECT id, path, name, value FROM (SELECT j.id, t.fullkey AS path, CASE WHEN regexp_matches(t.fullkey, '\\]$') THEN regexp_extract(t.fullkey, '\\.([a-z_]+)\\[\\d+\\]$', 1) ELSE t.key END AS name, t.atom->>'$' AS value, t.type FROM (SELECT o_orderkey AS id, {_JSON} AS doc FROM orders) AS j, json_tree(j.doc) AS t) WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def json_walk(spark, d):
    return records.walked(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_JSON).alias("doc")), "id", "doc")


@query(f"""SELECT DISTINCT id, number FROM (SELECT j.id, CASE WHEN t.key IN ('section_number', 'number') THEN t.atom->>'$' WHEN t.key IN ('section_id', 'id') AND (t.atom->>'$') LIKE 'section:%' THEN substr(t.atom->>'$', 9) END AS number FROM (SELECT o_orderkey AS id, {_JSON} AS doc FROM orders) AS j, json_tree(j.doc) AS t) WHERE regexp_full_match(number, '\\d{{3,4}}(\\.\\d+)*')""")
def json_sections(spark, d):
    return records.named_sections(json_walk(spark, d), "id")


_PARAMETERS = choose("c_custkey", ["concat('{\"a\": ', c_nationkey, ', \"b\": [1, \"x\", null, {\"c\": true}]}')", "concat('[', c_nationkey, ']')", "concat('{\"a\": ', c_name)", "NULL", "'{}'", "concat('\"', c_name, '\"')"])


@query(f"SELECT id, CASE WHEN p IS NULL THEN 'missing' WHEN NOT json_valid(p) THEN 'not JSON' WHEN json_type(p) <> 'OBJECT' THEN 'not an object' END AS problem FROM (SELECT c_custkey AS id, {_PARAMETERS} AS p FROM customer)")
def parameter_types(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), records.parameter_problem(F.expr(_PARAMETERS)).alias("problem"))


_NULLED = """concat('{"a":', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE CAST(c_nationkey AS STRING) END, ',"b":{"c":', CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '"x"' END, ',"d":1},"l":[{"e":null,"f":', c_custkey, '}]}')"""


@query("""SELECT c_custkey, '{' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '"a":' || c_nationkey || ',' END || '"b":{' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '"c":"x",' END || '"d":1},"l":[{"f":' || c_custkey || '}]}' AS doc FROM customer""")
def json_without_nulls(spark, d):
    return table(spark, d, "customer").select("c_custkey", records.without_nulls(F.expr(_NULLED), "a int, b struct<c:string,d:int>, l array<struct<e:string,f:int>>").alias("doc"))


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"when":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","tags":["' || o_orderstatus || '",null],"none":null}' AS doc FROM orders""")
def json_safe(spark, d):
    tags = F.array(F.col("o_orderstatus"), F.lit(None).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", records.json_safe({"key": F.col("o_orderkey"), "when": F.col("o_orderdate").cast("timestamp_ntz"), "tags": tags, "none": F.lit(None).cast("string")}).alias("doc"))


_OUTPUT = """concat('{"type":"', CASE c_custkey % 3 WHEN 0 THEN 'function_call' WHEN 1 THEN 'reasoning' ELSE 'message' END, '","id":"i', c_custkey, '","name":"search","status":"done","summary":"s', c_nationkey, '","role":"assistant"}')"""


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{"type":"function_call","id":"i' || c_custkey || '","name":"search"}' WHEN 1 THEN '{"type":"reasoning","id":"i' || c_custkey || '","summary":"s' || c_nationkey || '"}' ELSE '{"type":"message","id":"i' || c_custkey || '","name":"search","role":"assistant"}' END AS item FROM customer""")
def resumable_items(spark, d):
    return table(spark, d, "customer").select("c_custkey", records.resumable(F.expr(_OUTPUT)).alias("item"))


# --- sessions, caches and models --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id AS session, arg_max(event_id, event_id) AS e FROM events WHERE user_id % 6 > 0 GROUP BY user_id), a AS (SELECT c_custkey AS session, c_nationkey % 4 AS sha FROM customer)
SELECT a.session, CASE WHEN e IS NULL THEN 'start' WHEN e % 5 = 0 THEN 'refuse: version' WHEN a.session % 4 <> sha THEN 'refuse: source' WHEN e % 2 = 0 THEN 'replay' ELSE 'resume' END AS action,
CASE WHEN e IS NOT NULL AND e % 5 > 0 AND a.session % 4 = sha AND e % 2 = 1 THEN 'p' || (e % 3) END AS phase, CASE WHEN e IS NOT NULL AND e % 5 > 0 AND a.session % 4 = sha AND e % 2 = 0 THEN 'r' || e END AS result FROM a LEFT JOIN s USING (session)""")
def checkpoint_restore(spark, d):
    saved = sql(spark, d, "SELECT user_id AS session, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS version, user_id % 4 AS source_sha, concat('p', event_id % 3) AS phase, CASE WHEN event_id % 2 = 0 THEN concat('r', event_id) END AS result, event_id AS at FROM {events} WHERE user_id % 6 > 0")
    return records.restored(saved, sql(spark, d, "SELECT c_custkey AS session, c_nationkey % 4 AS source_sha FROM {customer}"), 2)


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 3 > 0 INTERSECT SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 > 0")
def cache_rewrite(spark, d):
    x = sql(spark, d, "SELECT doc_id, sha2(coalesce(text, ''), 256) AS sha FROM {documents}")
    return records.current_cache(x.where("doc_id % 3 > 0").select("sha"), x.where("doc_id % 2 > 0"))


@query("SELECT l.doc_id AS requirement, sha256(coalesce(text, '')) AS sha FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 0")
def requirement_hashes(spark, d):
    reqs = sql(spark, d, "SELECT doc_id AS requirement, toxic = 1 AS needs_review FROM {labels}")
    return records.named_hashes(reqs, sql(spark, d, "SELECT doc_id AS requirement, sha2(coalesce(text, ''), 256) AS sha FROM {documents}"))


@query("SELECT DISTINCT source AS block FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def review_blocks(spark, d):
    return sql(spark, d, "SELECT d.source AS block FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 1").distinct()


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE p_type WHEN 'x' THEN 'y' ELSE p_type END, 'unknown') AS source_type FROM lineitem LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_size > 10) ON p_partkey = l_partkey""")
def source_type_lookup(spark, d):
    types = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, d, "lineitem").join(types, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_type", F.lit("unknown")).alias("source_type"))


@query("""SELECT doc_id AS span_id, sha256('Extract the requirements of this text. Quote it exactly; add nothing that it does not say.' || chr(10) || 'Section: ' || source || chr(10) || 'Text: ' || coalesce(text, '')) AS sha FROM documents""")
def model_prompts(spark, d):
    spans = table(spark, d, "documents").select(F.col("doc_id").alias("span_id"), F.col("source").alias("section"), "text")
    return records.prompts(spans).select("span_id", F.sha2("prompt", 256).alias("sha"))


_SAID = """SELECT o_orderkey AS span_id, CASE WHEN o_orderkey % 6 = 0 THEN 'no answer' ELSE concat('[{"source_text":"Order ', CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END, ' shall be kept","clause":"', CASE WHEN o_orderkey % 7 = 0 THEN 'may go' ELSE 'shall be kept' END, '"}]') END AS response FROM {orders}"""


@query("""SELECT o_orderkey AS span_id, CASE WHEN o_orderkey % 6 > 0 THEN 0 END AS ordinal, o_orderkey % 6 > 0 AND o_custkey % 8 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AS ok,
CASE WHEN o_orderkey % 6 = 0 THEN 'no items' WHEN o_custkey % 8 = 0 THEN 'unknown span' WHEN o_orderkey % 5 = 0 THEN 'other source' WHEN o_orderkey % 7 = 0 THEN 'not in the source' END AS problem FROM orders""")
def grounded_responses(spark, d):
    said = table(spark, d, "orders").select(F.col("o_orderkey").alias("span_id"), F.expr(_SAID[_SAID.index("CASE") : _SAID.index(" AS response")]).alias("response"))
    spans = sql(spark, d, "SELECT o_orderkey AS span_id, concat('Order ', o_custkey, ' shall be kept') AS text FROM {orders} WHERE o_custkey % 8 > 0")
    return records.grounded(said, spans)


_FENCED = "SELECT c_custkey AS id, " + choose("c_custkey", ["concat('```sql\n', 'SELECT ', c_custkey, ' AS a LIMIT 1;\n```')", "concat('  SELECT ', c_custkey, ' AS a LIMIT 1 ; ')", "concat('```SELECT ', c_custkey, ' AS a LIMIT 1```')"]) + " AS q FROM {customer}"


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'SELECT ' END || c_custkey || ' AS a LIMIT 1' AS query FROM customer")
def unfenced_queries(spark, d):
    return sql(spark, d, _FENCED).select("id", records.unfenced(F.col("q")).alias("query"))


_RESPONSE = """concat('{"usage":{"input_tokens":', c_custkey, CASE WHEN c_custkey % 4 > 0 THEN concat(',"output_tokens":', c_nationkey) ELSE '' END, '},"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":"', c_name, '"},{"type":"other","text":"x"},{"type":"output_text","text":"!"}]}]}')"""


@query("SELECT c_custkey, c_custkey AS input_tokens, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey ELSE 0 END AS output_tokens, c_name || '!' AS text FROM customer")
def response_usage(spark, d):
    return table(spark, d, "customer").select("c_custkey", records.usage_of(F.expr(_RESPONSE)).alias("u")).select("c_custkey", "u.*")


def _template_answer(questions: list[str]) -> list[str]:
    """A stand-in for a model: it repeats the last word, and fails on questions that end in 7."""
    if any(q.endswith("7") for q in questions):
        raise ValueError("cannot say")
    return [f"It is {q.split()[-1]} [E1]." for q in questions]


@query("""SELECT c_custkey AS "case", CASE WHEN c_custkey % 10 <> 7 THEN 'It is ' || c_custkey || ' [E1].' END AS answer, CASE WHEN c_custkey % 10 = 7 THEN 'ValueError: cannot say' END AS error FROM customer""")
def answer_run(spark, d):
    cases = sql(spark, d, "SELECT c_custkey AS case, concat('Where is ', c_custkey) AS question FROM {customer}")
    return records.answered(cases, _template_answer)


@query("""WITH h AS (SELECT DISTINCT l_returnflag AS mode, l_orderkey AS c, l_suppkey AS s FROM lineitem WHERE l_linenumber <= 3), e AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS s FROM lineitem WHERE l_quantity > 10), t AS (SELECT c, count(*) AS total FROM e GROUP BY c),
f AS (SELECT mode, c, count(*) AS found FROM h JOIN e USING (c, s) GROUP BY ALL), m AS (SELECT DISTINCT l_returnflag AS mode FROM lineitem)
SELECT mode, count(*) AS n, round(avg(coalesce(found, 0) / total), 6) AS recall, round(avg(CASE WHEN found > 0 THEN 1 ELSE 0 END), 6) AS hit_rate FROM t CROSS JOIN m LEFT JOIN f USING (mode, c) GROUP BY mode""")
def retrieval_ablation(spark, d):
    hits = sql(spark, d, "SELECT l_returnflag AS mode, l_orderkey AS case, l_suppkey AS section, l_linenumber AS rank FROM {lineitem}")
    return records.ablation(hits, sql(spark, d, "SELECT l_orderkey AS case, l_suppkey AS section FROM {lineitem} WHERE l_quantity > 10"), 3)


@query("SELECT n_name AS canonical, coalesce(array_to_string(list_sort(list(DISTINCT c_mktsegment) FILTER (c_mktsegment IS NOT NULL)), ','), '') AS synonyms FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 8000 GROUP BY n_name")
def synonyms_of(spark, d):
    synonyms = sql(spark, d, "SELECT n.n_name AS canonical, c.c_mktsegment AS synonym FROM {nation} n JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 8000")
    return records.synonyms_of(table(spark, d, "nation").select(F.col("n_name").alias("canonical")), synonyms).select("canonical", F.array_join("synonyms", ",").alias("synonyms"))


@query("SELECT 'case:' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 20) AS case_id, o_orderpriority AS predicate, array_to_string(list_sort(list(DISTINCT l_partkey))[1:3], ',') AS values FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority")
def golden_cases(spark, d):
    reqs = sql(spark, d, "SELECT o.o_orderkey AS requirement, o.o_orderpriority AS predicate, o.o_orderstatus AS subject, sort_array(collect_set(l.l_partkey)) AS values FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
    return records.golden(reqs).select("case_id", "predicate", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"))


@query("SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'section_v2' WHEN 1 THEN 'requirement_v2' ELSE 'name' || s_nationkey END AS index_name FROM supplier")
def index_migration(spark, d):
    moved = spark.createDataFrame([("section_v1", "section_v2"), ("requirement_v1", "requirement_v2")], "old string, new string")
    asked = table(spark, d, "supplier").select("s_suppkey", F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'section_v1' WHEN 1 THEN 'requirement_v1' ELSE concat('name', s_nationkey) END").alias("old"))
    return asked.join(moved, "old", "left").select("s_suppkey", F.coalesce("new", "old").alias("index_name"))


@query("SELECT DISTINCT l_suppkey AS source, l_partkey AS target, CAST(l_quantity AS INTEGER) AS inches FROM lineitem WHERE l_returnflag = 'R' ORDER BY inches DESC, source, target LIMIT 100")
def clearance_from_material(spark, d):
    """The hundred largest: a report."""
    edges = sql(spark, d, "SELECT DISTINCT l_suppkey AS source, l_partkey AS target, CAST(l_quantity AS INT) AS inches FROM {lineitem} WHERE l_returnflag = 'R'")
    return edges.orderBy(F.desc("inches"), "source", "target").limit(100)


# --- files and small rules ------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS k, '["' || o_orderstatus || '","x"]' AS tags, 'say "' || o_orderpriority || '",' || chr(10) || 'and more' AS t FROM orders""")
def csv_round_trip(spark, d):
    """Written with lists as JSON, other columns left out, and read back with its schema; a file that is not there adds nothing."""
    rows = sql(spark, d, "SELECT o_orderkey AS k, array(o_orderstatus, 'x') AS tags, concat('say \"', o_orderpriority, '\",\n', 'and more') AS t, 1 AS dropped FROM {orders}")
    path = place(spark, "csv")
    files.write_csv(rows, path, ["k", "tags", "t"])
    return files.read_csv(spark, path, "k long, tags string, t string").unionByName(files.read_csv(spark, path + "-none", "k long, tags string, t string"))


@query("SELECT s_suppkey, s_name || '!' AS s_name FROM supplier")
def replaced_table(spark, d):
    """A table that is replaced while the old one is its own input; the second version is what is read."""
    path = place(spark, "replaced")
    files.replace(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    files.replace(spark.read.parquet(path).withColumn("s_name", F.concat("s_name", F.lit("!"))), path)
    return files.load_or_create(spark, path, lambda: table(spark, d, "nation"))


@query("""SELECT c_custkey AS doc, c_name AS title, CAST(o_orderkey AS BIGINT) AS child FROM customer JOIN orders ON o_custkey = c_custkey""")
def json_documents(spark, d):
    """Documents with nested children, written as JSON and read with a fixed schema; children are then rows."""
    path = place(spark, "json")
    docs = sql(spark, d, "SELECT c.c_custkey AS doc, c.c_name AS title, collect_list(named_struct('id', o.o_orderkey)) AS children FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY ALL")
    docs.write.json(path)
    back = spark.read.schema("doc long, title string, children array<struct<id:long>>").option("mode", "FAILFAST").json(path)
    return back.select("doc", "title", F.explode("children").alias("x")).select("doc", "title", F.col("x.id").alias("child"))


@query("""SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY""")
def expired_files(spark, d):
    listed = table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))
    return stream.expired(listed, 7, "2024-01-20 00:00:00").select(F.col("path").alias("event_id"))


@query("""SELECT 'few' AS name, CASE WHEN count(*) > 100 THEN 'too many rows' WHEN coalesce(sum(strlen(n_name) + 2), 0) > 1000 THEN 'too many bytes' ELSE 'ok' END AS status FROM nation UNION ALL SELECT 'many', CASE WHEN count(*) > 100 THEN 'too many rows' ELSE 'ok' END FROM lineitem
UNION ALL SELECT 'long', CASE WHEN count(*) > 100 THEN 'too many rows' WHEN sum(strlen(s_name) + 2) > 1000 THEN 'too many bytes' ELSE 'ok' END FROM supplier""")
def bounded_results(spark, d):
    """A result beyond its bounds is an error and not cut; counting stops one row behind the bound."""
    asked = {"few": table(spark, d, "nation").select("n_name"), "many": table(spark, d, "lineitem").select("l_orderkey"), "long": table(spark, d, "supplier").select("s_name")}
    out = None
    for name, df in asked.items():
        one = guard.bounds(df, 100, 1000).select(F.lit(name).alias("name"), "status")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_partkey AS id, p_size % 3 = 0 OR p_partkey % 4 = 0 OR p_size % 7 = 0 AS residue, CAST(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS INTEGER) AS parsed, CAST(800 - least(p_size, 7) - abs(p_size - 7) AS DOUBLE) AS top, 'Q' || p_size || ',X' AS names, lower(replace(p_name, '-', ' ')) || ' ' || p_size AS signature, lower(p_name) AS folded FROM part""")
def small_rules(spark, d):
    rows = sql(spark, d, """SELECT p_partkey AS id, p_name, p_size, CASE WHEN p_size % 3 = 0 THEN 't1' END AS table_id, CASE WHEN p_partkey % 4 = 0 THEN 'table:9' ELSE 'section:9' END AS parent, CASE WHEN p_size % 7 = 0 THEN 'a Table Source line' END AS why,
      concat('Q', p_size, ' = X; X = 1') AS formula FROM {part}""")
    box = rules.box(F.struct(F.lit(0.0).alias("l"), F.col("p_size").cast("double").alias("t"), F.lit(1.0).alias("r"), F.lit(7.0).alias("b")), 800.0)
    json = F.when(F.col("id") % 5 == 0, "NaN").otherwise(F.concat(F.lit('{"n": '), "p_size", F.lit("}")))
    parsed = rules.json_or(json, "n int", F.struct(F.lit(-1).alias("n")))["n"]
    return rows.select("id", rules.table_residue(F.col("table_id"), F.col("parent"), F.col("why")).alias("residue"), parsed.alias("parsed"), box["top"].alias("top"), F.array_join(rules.formula_names(F.col("formula")), ",").alias("names"), rules.signature(F.concat_ws(" ", "p_name", "p_size")).alias("signature"), nfkc(F.upper("p_name")).alias("folded"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS INTEGER) AS n, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')[1], '') AS first FROM documents WHERE text IS NOT NULL")
def unicode_words(spark, d):
    ws = unicode_tokens(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", ws.alias("ws")).select("doc_id", F.size("ws").alias("n"), F.coalesce(F.get("ws", F.lit(0)), F.lit("")).alias("first"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(CAST(300 + p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.' || p_partkey ELSE '' END, '\\d{3,4}(\\.\\d+)+') AND p_size = 7")
def exact_sections(spark, d):
    """Sections asked for by their number: it must have a dot, a bare chapter number is no section."""
    named = sql(spark, d, "SELECT p_partkey, p_name, p_size, concat(300 + p_size, CASE WHEN p_partkey % 2 = 0 THEN concat('.', p_partkey) ELSE '' END) AS number FROM {part}")
    return named.where(F.col("number").rlike(r"^\d{3,4}(\.\d+)+$") & F.startswith("number", F.lit("307"))).select("p_partkey", "p_name")


@query("""WITH r AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY embedding ORDER BY vec_id) AS n FROM embeddings), q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS score FROM r, q WHERE n = 1 AND label <> 3 ORDER BY score DESC, vec_id LIMIT 10""")
def representative_topk(spark, d):
    """The nearest of one vector a digest, without those of the unassigned label."""
    v = table(spark, d, "embeddings").withColumn("sha", F.sha2(F.to_json("embedding"), 256))
    one = refresh.representatives(v, "vec_id", "sha").where("is_representative").select("vec_id").join(v, "vec_id").where("label <> 3")
    return retrieval.cosine(one, v.where("vec_id = 0").select(F.col("embedding").alias("q")))


@query("SELECT doc_id, lang, CAST(n_chars AS INTEGER) AS n_chars, CAST(NULL AS VARCHAR) AS note FROM documents WHERE lang IN ('en', 'fr')")
def allow_list_export(spark, d):
    contract = spark.createDataFrame([], "doc_id long, lang string, n_chars int, note string").schema
    return files.conform(table(spark, d, "documents").where("lang IN ('en', 'fr')"), contract)


@query("""WITH c AS (SELECT 'c' || c_custkey AS candidate, 'n' || c_nationkey AS p FROM customer), a AS (SELECT candidate, candidate AS node FROM c UNION ALL SELECT candidate, p FROM c UNION ALL SELECT candidate, 'r' || n_regionkey FROM c JOIN nation ON p = 'n' || n_nationkey)
SELECT candidate, 'E' || node AS evidence_id FROM a WHERE node LIKE 'n%' OR node IN ('r1', 'r3')""")
def evidence_attribution(spark, d):
    edges = sql(spark, d, "SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS child FROM {nation} UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM {customer}")
    known = sql(spark, d, "SELECT concat('n', n_nationkey) AS node FROM {nation} UNION ALL SELECT 'r1' UNION ALL SELECT 'r3'").select("node", F.concat(F.lit("E"), "node").alias("evidence_id"))
    return evidence.attributed(sql(spark, d, "SELECT concat('c', c_custkey) AS candidate FROM {customer}"), known, edges)


@query("SELECT source, lang, arg_min(doc_id, doc_id) AS doc_id FROM documents GROUP BY source, lang, lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x{00A0}]+', ' ', 'g')))")
def distinct_passages(spark, d):
    p = table(spark, d, "documents").select(F.col("source").alias("section"), F.col("lang").alias("page"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return evidence.distinct_passages(p).select(F.col("section").alias("source"), F.col("page").alias("lang"), F.col("ord").alias("doc_id"))
