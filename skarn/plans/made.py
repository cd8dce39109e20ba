"""Queries of the rules on lines, clauses, answers and names, over rows that are made of the tables by SQL both engines read alike.

What DuckDB expects is computed by it: from the same texts by its own functions, or from the numbers that the texts were made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import requirements as R
from skarn.functions import rules, similarity, vocabulary
from skarn.functions.text import tokens
from skarn.operators import answers, audit, inventory, structure, validation
from skarn.operators import extraction as E
from skarn.plans.queries import query
from skarn.plans.records import choose, plain
from skarn.sources import guard
from skarn.sources.tables import sql, table

# --- clauses --------------------------------------------------------------------------------------------------------

_CLAUSES = "SELECT p_partkey AS id, p_size AS n, " + choose("p_partkey", [
    "concat('Exhaust ducts shall not be installed in room ', p_size)", "concat('A clearance of ', p_size, ' inches shall be maintained')", "concat('Systems shall be installed in accordance with NFPA ', p_size, ' and Section 305.', p_size)",
    "concat('The minimum airflow is ', p_size, ' cfm')", "concat('Pressure must not exceed the maximum of ', p_size, ' psi')", "'Flexible ducts are permitted'", "concat('Smoke detectors of type ', p_size, ' shall be listed')",
    "'Access must be provided'", "concat('General notes ', p_size)", "concat('At most ', p_size, ' vents per Table 403.', p_size)", "'Openings may be located outdoors'",
]) + " AS clause FROM {part}"
_KIND = r"""CASE WHEN regexp_matches(c, '\b(shall not|must not|may not|prohibited|not be permitted)\b') THEN 'PROHIBITED_IN' WHEN regexp_matches(c, '\bclearances?\b') AND regexp_matches(c, '\b(shall|must|required|minimum|not less)\b') THEN 'REQUIRES_CLEARANCE'
WHEN regexp_matches(c, '\b(in accordance with|comply|compliance|conform)\b') THEN 'MUST_COMPLY_WITH' WHEN regexp_matches(c, '\b(minimum|not less than|at least|no less than)\b') THEN 'MINIMUM' WHEN regexp_matches(c, '\b(maximum|not more than|not exceed|at most)\b') THEN 'MAXIMUM'
WHEN regexp_matches(c, '\b(permitted|allowed|may)\b') THEN 'PERMITTED_IN' WHEN regexp_matches(c, '\b(devices?|detectors?|alarms?|dampers?|valves?|fans?|systems?|equipment|appliances?)\b') AND regexp_matches(c, '\b(shall|must|required)\b') THEN 'REQUIRES_DEVICE' WHEN regexp_matches(c, '\b(shall|must|required)\b') THEN 'REQUIRES' END"""


@query(f"SELECT id, {_KIND} AS predicate FROM (SELECT id, lower(clause) AS c FROM ({plain(_CLAUSES)}))")
def predicate_classifier(spark, d):
    return sql(spark, d, _CLAUSES).select("id", R.predicate(F.col("clause")).alias("predicate"))


@query("SELECT p_partkey AS id, 'section' AS kind, '305.' || p_size AS value FROM part WHERE p_partkey % 11 = 2 UNION ALL SELECT p_partkey, 'standard', 'NFPA ' || p_size FROM part WHERE p_partkey % 11 = 2 UNION ALL SELECT p_partkey, 'table', '403.' || p_size FROM part WHERE p_partkey % 11 = 9")
def references_extract(spark, d):
    return sql(spark, d, _CLAUSES).select("id", F.explode(R.references(F.col("clause"))).alias("r")).select("id", "r.kind", "r.value")


_SPANS = "SELECT 'document:1' AS document_id, CAST(p_partkey AS STRING) AS span_id, 'section_text' AS source_type, concat(" + choose("p_partkey", ["concat('Ducts of type ', p_size, ' shall not be placed in closet ', p_size)", "concat('Fans shall be kept ', p_size, ' inches from walls where the air is dry')", "concat('General notes ', p_size)", "concat('Vents must be tested unless listed')"]) + ", '; See Section 30', p_size, '.') AS text FROM {part}"


@query("""SELECT 'requirement:' || substr(sha256('document:1|' || p_partkey || '|0|' || predicate || '|' || clause), 1, 20) AS requirement_id, CAST(p_partkey AS VARCHAR) AS span_id, clause, predicate, subject, object, condition, value, has_exception FROM (
SELECT p_partkey, 'Ducts of type ' || p_size || ' shall not be placed in closet ' || p_size AS clause, 'PROHIBITED_IN' AS predicate, 'Ducts of type ' || p_size AS subject, 'be placed in closet ' || p_size AS object, NULL AS condition, NULL AS value, false AS has_exception FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'Fans shall be kept ' || p_size || ' inches from walls where the air is dry', 'REQUIRES_DEVICE', 'Fans', 'be kept ' || p_size || ' inches from walls', 'where the air is dry', p_size || ' inches', false FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 'Vents must be tested unless listed', 'REQUIRES', 'Vents', 'be tested', 'unless listed', NULL, true FROM part WHERE p_partkey % 4 = 3)""")
def clause_requirements(spark, d):
    made = R.requirements(sql(spark, d, _SPANS))
    return made.select("requirement_id", "span_id", "clause", "predicate", "subject", "object", "condition", "value", "has_exception")


# --- answers --------------------------------------------------------------------------------------------------------

_ANSWERS = "SELECT o_orderkey AS id, " + choose("o_orderkey", ["concat('Vents end outdoors [E', o_custkey % 3, ']. Ducts are sealed [E2][E', o_custkey % 5, '].')", "concat('No citation for ', o_custkey)", "concat('See [E', o_custkey, '] and [Section 4].')", "concat('Twice [E', o_custkey % 3, '][E', o_custkey % 3, '].')"]) + " AS answer FROM {orders}"
_CITED = "SELECT id, answer, list_filter(x, lambda v, i: list_position(x, v) = i) AS cited FROM (SELECT id, answer, regexp_extract_all(answer, '\\[(E\\d+)\\]', 1) AS x FROM (" + plain(_ANSWERS) + "))"


@query(f"SELECT id, array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda v: v NOT IN ('E1', 'E2')), ',') AS unknown, contains(answer, '[Section') AS forbidden, len(cited) > 0 AS has_citation FROM ({_CITED})")
def citation_binding(spark, d):
    return validation.citations(sql(spark, d, _ANSWERS).withColumn("allowed", F.array(F.lit("E1"), F.lit("E2"))))


@query(f"SELECT id, CASE WHEN len(list_filter(cited, lambda v: v NOT IN ('E2', 'E3'))) = 0 THEN 'uncovered' WHEN len(list_filter(cited, lambda v: v NOT IN ('E2', 'E3'))) < len(cited) THEN 'partial' ELSE 'unchanged' END AS impact FROM ({_CITED}) WHERE len(cited) > 0")
def citation_impact(spark, d):
    cited = validation.citations(sql(spark, d, _ANSWERS).withColumn("allowed", F.array(F.lit("E1")))).where("has_citation")
    return validation.impact(cited.select("id", F.split("cited", ",").alias("cited")), ["E2", "E3"])


@query("""SELECT o_orderkey AS id, o_custkey % 40 = (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 40 AND o_orderkey % 7 > 0 AND o_orderkey % 6 > 0 AS valid FROM orders""")
def claims_valid(spark, d):
    claims = sql(spark, d, """SELECT o_orderkey AS id, concat('A clearance of ', o_custkey % 40, ' inches applies') AS claim, array(concat('E', CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey END)) AS cited,
      CASE WHEN o_orderkey % 6 = 0 THEN '18' ELSE concat('clearance  of ', (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 40, ' inches') END AS quote FROM {orders}""")
    evidence = sql(spark, d, "SELECT concat('E', o_orderkey) AS evidence_id, concat('A clearance of ', (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 40, '   inches shall be kept') AS source FROM {orders}")
    return validation.claims(claims, evidence)


_QUANTITIES = "SELECT p_partkey AS id, " + choose("p_partkey", ["concat(p_size, '-inch clear, ', p_size, ' 1/2 feet high')", "concat('at 1,', 100 + p_size, ' cfm')", "concat('below -', p_size, '/4 psi')", "concat('none in x', p_size, ' here')", "concat(p_size, ' sq. ft. and ', p_size, ' ft3/min')", "concat(p_size, '.50 hr')", "concat(p_size, ' pounds per  square inch, ', p_size, '″ and 7m')", "concat(p_size, ' degrees F, ', p_size, ' m² by ', p_size, '%')"]) + " AS text FROM {part}"


@query("""SELECT id, n, CAST(a / gcd(a, b) AS INTEGER) AS num, CAST(b / gcd(a, b) AS INTEGER) AS den, unit FROM (
SELECT p_partkey AS id, 0 AS n, p_size AS a, 1 AS b, 'inch' AS unit FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT p_partkey, 1, 2 * p_size + 1, 2, 'foot' FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT p_partkey, 0, 1100 + p_size, 1, 'cfm' FROM part WHERE p_partkey % 8 = 1
UNION ALL SELECT p_partkey, 0, -p_size, 4, 'psi' FROM part WHERE p_partkey % 8 = 2 UNION ALL SELECT p_partkey, 0, p_size, 1, 'ft2' FROM part WHERE p_partkey % 8 = 4 UNION ALL SELECT p_partkey, 1, p_size, 1, 'cfm' FROM part WHERE p_partkey % 8 = 4
UNION ALL SELECT p_partkey, 0, p_size * 100 + 50, 100, 'hour' FROM part WHERE p_partkey % 8 = 5 UNION ALL SELECT p_partkey, 0, p_size, 1, 'psi' FROM part WHERE p_partkey % 8 = 6 UNION ALL SELECT p_partkey, 1, p_size, 1, 'inch' FROM part WHERE p_partkey % 8 = 6 UNION ALL SELECT p_partkey, 2, 7, 1, 'metre' FROM part WHERE p_partkey % 8 = 6
UNION ALL SELECT p_partkey, 0, p_size, 1, 'fahrenheit' FROM part WHERE p_partkey % 8 = 7 UNION ALL SELECT p_partkey, 1, p_size, 1, 'm2' FROM part WHERE p_partkey % 8 = 7 UNION ALL SELECT p_partkey, 2, p_size, 1, 'percent' FROM part WHERE p_partkey % 8 = 7)""")
def quantity_bindings(spark, d):
    return validation.quantities(sql(spark, d, _QUANTITIES))


@query("SELECT p_partkey AS id, p_partkey % 3 > 0 AND contains(lower(p_name), 'r') AS covered FROM part")
def anchor_coverage(spark, d):
    rows = sql(spark, d, "SELECT p_partkey AS id, concat('Keep ', p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END, ' Inches from ', p_name) AS text, array(concat('keep ', p_size, ' inches'), CASE WHEN contains(lower(p_name), 'r') THEN p_name ELSE 'walls' END) AS anchors FROM {part}")
    return rows.select("id", F.forall("anchors", lambda a: F.contains(F.lower("text"), F.lower(a))).alias("covered"))


_ASKED = "SELECT c_custkey AS id, " + choose("c_custkey", ["concat('SELECT a FROM t LIMIT ', c_nationkey)", "'DROP TABLE t'", "concat('SELECT ', c_nationkey, ' LIMIT 1; SELECT 2 LIMIT 1')", "'WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x LIMIT 1'", "concat('SELECT ', c_nationkey, ' FROM t')", "concat('SELECT a FROM t LIMIT ', 90 + c_nationkey)", "concat('SELECT ''set; drop'' AS a, ', c_nationkey, ' LIMIT 100;')", "concat('SELECT a -- x', c_nationkey, ' LIMIT 5')"]) + " AS q FROM {customer}"


@query(f"""SELECT id, CASE WHEN contains(b, '--') THEN 'comment' WHEN contains(b, ';') THEN 'more than one statement' WHEN NOT regexp_matches(b, '(?i)^(select|with)\\b') THEN 'not a query' WHEN regexp_matches(b, '(?i)\\b(insert|update|delete|drop|set)\\b') THEN 'writes'
WHEN NOT regexp_matches(b, '(?i)\\blimit\\s+\\d+$') THEN 'no limit at its end' WHEN CAST(regexp_extract(b, '(?i)limit\\s+(\\d+)$', 1) AS INTEGER) > 100 THEN 'limit above 100' END AS problem FROM (SELECT id, regexp_replace(regexp_replace(q, '''[^'']*''', '''''', 'g'), ';$', '') AS b FROM ({plain(_ASKED)}))""")
def sql_guard(spark, d):
    return guard.problems(sql(spark, d, _ASKED), "id", "q")


@query("SELECT id, problem FROM (SELECT c_custkey AS id, " + choose("c_custkey", ["NULL", "'number of claims'", "'not an answer'", "'unknown type'", "NULL", "'incomplete claim'"]) + " AS problem FROM customer)")
def claim_schema(spark, d):
    said = sql(spark, d, "SELECT c_custkey AS id, " + choose("c_custkey", ["concat('!\"answer_type\": \"grounded\", \"claims\": [!\"text\": \"', c_name, '\", \"evidence_ids\": [\"E', c_nationkey, '\"], \"quotes\": [!\"evidence_id\": \"E1\", \"quote\": \"q\"?]?]?')", "'!\"answer_type\": \"grounded\", \"claims\": []?'", "c_name", "concat('!\"answer_type\": \"', c_name, '\"?')", "'!\"answer_type\": \"abstain\"?'", "concat('!\"answer_type\": \"grounded\", \"claims\": [!\"text\": \"', c_name, '\", \"evidence_ids\": []?]?')"]) + " AS answer FROM {customer}")
    return said.select("id", answers.schema_problem(F.translate("answer", "!?", "{}")).alias("problem"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS c, 'E' || l_linenumber AS e, l_suppkey % 3 AS s FROM lineitem), a AS (SELECT o_orderkey AS c, CASE WHEN o_orderkey % 4 = 3 THEN [] ELSE list_distinct(['E' || (1 + o_custkey % 4), 'E' || (1 + o_orderkey % 4)]) END AS cited, o_orderkey % 5 = 0 AS bad, o_custkey % 3 AS s FROM orders),
k AS (SELECT c, list(DISTINCT e) AS known FROM e GROUP BY c)
SELECT a.c AS "case", CAST(len(cited) AS INTEGER) AS n_cited, CAST(len(list_filter(cited, lambda x: NOT list_contains(coalesce(known, []), x))) AS INTEGER) AS n_unknown, CASE WHEN bad THEN 1 ELSE 0 END AS n_malformed,
len(cited) > 0 AND NOT bad AND len(list_filter(cited, lambda x: NOT list_contains(coalesce(known, []), x))) = 0 AND EXISTS (SELECT 1 FROM e WHERE e.c = a.c AND e.s = a.s AND list_contains(cited, e.e)) AS valid FROM a LEFT JOIN k ON k.c = a.c""")
def answer_checks(spark, d):
    given = sql(spark, d, "SELECT o_orderkey AS case, concat('So', CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE concat(' [E', 1 + o_custkey % 4, '][E', 1 + o_orderkey % 4, ']') END, CASE WHEN o_orderkey % 5 = 0 THEN ' [Section 3]' ELSE '' END, '.') AS text, o_custkey % 3 AS expected FROM {orders}")
    return answers.checked(given, sql(spark, d, "SELECT l_orderkey AS case, concat('E', l_linenumber) AS evidence_id, l_suppkey % 3 AS section FROM {lineitem}"))


# --- names ----------------------------------------------------------------------------------------------------------


@query("""SELECT term, c AS canonical FROM (SELECT DISTINCT upper(p_name) AS term FROM part UNION ALL SELECT n_name FROM nation) LEFT JOIN (SELECT lower(p_name) AS k, arg_max(p_brand, p_partkey) AS c FROM part GROUP BY 1) ON k = lower(term)""")
def synonym_exact(spark, d):
    terms = sql(spark, d, "SELECT DISTINCT upper(p_name) AS term FROM {part} UNION ALL SELECT n_name FROM {nation}")
    return vocabulary.exact(terms, sql(spark, d, "SELECT p_name AS synonym, p_brand AS canonical, p_partkey AS place FROM {part}"))


@query("SELECT DISTINCT p_name || 'xx' AS term, p_name AS canonical, CAST(round(2.0 * length(p_name) / (2 * length(p_name) + 2), 6) AS DOUBLE) AS score FROM part WHERE 2.0 * length(p_name) / (2 * length(p_name) + 2) >= 0.8")
def synonym_fuzzy(spark, d):
    """Each name with two letters more is likest to itself: of the sums of matching blocks none can be larger."""
    return vocabulary.fuzzy(sql(spark, d, "SELECT DISTINCT concat(p_name, 'xx') AS term FROM {part}"), sql(spark, d, "SELECT p_name AS synonym, p_name AS canonical, min(p_partkey) AS place FROM {part} GROUP BY p_name"))


@query("""WITH w AS (SELECT ['to', 'nation', '3', 'and', 'nation', '11', 'by', 'region'] AS ws), p AS (SELECT list_concat(list_concat(list_transform(range(1, 6), lambda i: array_to_string(ws[i:i + 3], ' ')), list_transform(range(1, 7), lambda i: array_to_string(ws[i:i + 2], ' '))), list_concat(list_transform(range(1, 8), lambda i: array_to_string(ws[i:i + 1], ' ')), ws)) AS ps FROM w)
SELECT n AS name, CAST(list_position(ps, lower(n)) AS INTEGER) AS place FROM (SELECT replace(n_name, '_', ' ') AS n FROM nation UNION ALL SELECT 'Region'), p WHERE list_position(ps, lower(n)) > 0""")
def query_entities(spark, d):
    return E.query_entities("to nation 3 and NATION 11 by region", sql(spark, d, "SELECT replace(n_name, '_', ' ') AS name FROM {nation} UNION ALL SELECT 'Region'"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN round(4.0::DOUBLE / 6, 6) ELSE 0.0::DOUBLE END AS likeness FROM part")
def sequence_likeness(spark, d):
    """Side by side; two of three tokens in order; nothing in common."""
    pairs = sql(spark, d, "SELECT p_partkey AS id, concat('a', p_size, ' b c') AS a, " + choose("p_partkey", ["concat('x a', p_size, ' b c y')", "concat('a', p_size, ' z c')", "concat('q', p_size, ' r s')"]) + " AS b FROM {part}")
    return pairs.select("id", F.round(similarity.sequence_likeness(tokens(F.col("a")), tokens(F.col("b"))), 6).alias("likeness"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ffi' ELSE '' END || lower(p_name) AS text, CASE WHEN p_partkey % 2 = 0 THEN '0,0,0,' ELSE '' END || array_to_string(list_transform(range(0, length(p_name)), lambda i: i + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END), ',') AS places FROM part""")
def folded_offsets(spark, d):
    rows = sql(spark, d, "SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 2 = 0 THEN 'ﬃ' ELSE '  ' END, upper(p_name), ' ') AS s FROM {part}").withColumn("x", similarity.folded("s"))
    return rows.select("id", F.col("x.text").alias("text"), F.array_join(F.transform("x.places", lambda p: p.cast("string")), ",").alias("places"))


@query("SELECT p_partkey AS id, 'q' || p_size || '=axv' AS k FROM part")
def formula_keys(spark, d):
    rows = sql(spark, d, "SELECT p_partkey AS id, " + choose("p_partkey", ["concat('Equation ', p_size, '-', 3, ': Q', p_size, ' = A x V')", "concat('  Q', p_size, '=  a X v ')"]) + " AS f FROM {part}")
    return rows.select("id", E.formula_key(F.col("f")).alias("k"))


# --- lines ----------------------------------------------------------------------------------------------------------

_LINES = "SELECT o_custkey AS doc_id, o_orderkey AS line_index, CAST(o_orderkey % 9 AS INT) AS page, " + choose("o_orderkey DIV 3", ["concat('305.', o_custkey % 5, ' Supports')", "'[M] Exceptions:'", "'1.'", "concat('Ducts under ', o_custkey)", "'2'", "'Listed   units.'", "'Exception: none'", "'INSIGHTS (2)'", "concat('text ', o_custkey)"]) + " AS text FROM {orders}"
_DUCK_LINES = plain(_LINES).replace("DIV", "//")


@query(f"""WITH l AS (SELECT doc_id, line_index, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\[[A-Z]+\\]\\s*', '') AS p FROM ({_DUCK_LINES})),
e AS (SELECT *, regexp_matches(p, '^(\\d{{3,4}}(\\.\\d+)+\\s+\\S|(?i:exceptions?\\s*:|insights|user note))') AS edge FROM l), b AS (SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index ROWS UNBOUNDED PRECEDING) AS block FROM e),
m AS (SELECT *, coalesce(bool_or(edge AND regexp_matches(p, '(?i)^exceptions?\\s*:')) OVER (PARTITION BY doc_id, block), false) AS marked, nullif(regexp_extract(p, '^(\\d+)\\.?$', 1), '') AS number FROM b),
n AS (SELECT *, count(number) OVER (PARTITION BY doc_id, block ORDER BY line_index ROWS UNBOUNDED PRECEDING) AS k FROM m WHERE marked),
i AS (SELECT doc_id, block, k, max(number) AS number, string_agg(text, ' ' ORDER BY line_index) FILTER (number IS NULL) AS t FROM n WHERE k > 0 GROUP BY ALL), j AS (SELECT doc_id, block, string_agg(number || '=' || t, ';' ORDER BY k) AS items FROM i WHERE t IS NOT NULL GROUP BY ALL)
SELECT n.doc_id, min(line_index) AS first_line, max(line_index) AS last_line, string_agg(text, ' ' ORDER BY line_index) AS text, coalesce(any_value(items), '') AS items FROM n LEFT JOIN j ON j.doc_id = n.doc_id AND j.block = n.block GROUP BY n.doc_id, n.block""")
def exception_blocks(spark, d):
    found = structure.exception_blocks(sql(spark, d, _LINES).drop("page"))
    return found.select("doc_id", "first_line", "last_line", "text", F.array_join(F.transform("items", lambda i: F.concat_ws("=", i["number"], i["text"])), ";").alias("items"))


_ODD_LINES = "SELECT p_partkey AS id, CAST(p_size * 20 AS DOUBLE) AS top, " + choose("p_partkey", ["concat('305.', p_size, ' Supports')", "concat('Table 403.', p_size, ' Rates')", "concat('Q = A x ', p_size)", "'Exceptions: none'", "concat('a. footnote ', p_size)", "concat('See Section ', p_size)", "'***'", "concat('Ducts shall be sealed ', p_size)", "'User Note: x'", "concat('Page ', p_size)", "'INSIGHTS'", "concat('[M] ➡ 305.', p_size, '  General')", "concat('CHAPTER ', p_size, ' RULES')"]) + " AS text FROM {part}"
_ODD_DUCK = f"SELECT id, top, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, text FROM ({plain(_ODD_LINES)})"


@query(f"""SELECT id, CASE WHEN regexp_matches(t, '^\\d{{3,4}}(\\.\\d+)*\\.?\\s+\\S') THEN 'section_heading' WHEN regexp_matches(t, '(?i)^table\\s+\\d') THEN 'table_caption' WHEN regexp_matches(t, '(?i)^\\(?equation\\s+\\d|^[A-Za-z]\\w*\\s*=\\s*\\S') THEN 'equation' WHEN regexp_matches(t, '(?i)^exceptions?\\b') THEN 'exception' WHEN regexp_matches(t, '(?i)^insights?\\b') THEN 'insights'
WHEN regexp_matches(t, '(?i)^user notes?\\b') THEN 'user_note' WHEN regexp_matches(t, '^[a-z]\\.\\s') THEN 'table_footnote_candidate' WHEN top <= 55 AND regexp_matches(t, '(?i)\\bpage\\s+\\d+\\b') THEN 'navigation_artifact' WHEN regexp_matches(t, '(?i)^see\\s+(section|table|chapter)\\b') THEN 'cross_reference' WHEN regexp_matches(t, '^\\W*$') THEN 'source_artifact' ELSE 'normative_or_commentary_text' END AS category FROM ({_ODD_DUCK})""")
def source_line_category(spark, d):
    return sql(spark, d, _ODD_LINES).select("id", audit.line_category(F.col("text"), F.col("top")).alias("category"))


@query(f"""SELECT id, p AS plain, CASE WHEN regexp_matches(p, '(?i)^chapter\\s+\\d{{1,2}}\\b') THEN 'chapter' WHEN regexp_matches(p, '^\\d{{3,4}}(\\.\\d+)*\\.?\\s+\\S') THEN 'section' END AS kind,
CASE WHEN regexp_matches(p, '(?i)^chapter\\s+\\d{{1,2}}\\b') THEN regexp_extract(p, '(?i)^chapter\\s+(\\d{{1,2}})\\b', 1) WHEN regexp_matches(p, '^\\d{{3,4}}(\\.\\d+)*\\.?\\s+\\S') THEN regexp_extract(p, '^(\\d{{3,4}}(?:\\.\\d+)*)', 1) END AS identifier FROM (SELECT id, regexp_replace(t, '^\\s*(\\[[A-Z]+\\]\\s*)?(➡\\s*)*', '') AS p FROM ({_ODD_DUCK}))""")
def heading_identifiers(spark, d):
    lines = sql(spark, d, _ODD_LINES)
    return lines.select("id", rules.without_prefix(F.col("text")).alias("plain"), rules.heading_of(F.col("text")).alias("h")).select("id", "plain", "h.kind", "h.identifier")


_UNMATCHED = "SELECT p_partkey AS id, p_size % 7 = 0 AS nav, p_size % 5 = 0 AS head, p_size % 4 = 0 AS tab, 1 + p_size % 2 AS same, " + choose("p_partkey", ["concat('Page ', p_size)", "concat('https://codes.example.org/', p_size)", "concat('User note: see ', p_size)", "concat('Said here ', p_size)", "'#### **** ----'", "concat('Ducts shall be kept ', p_size)", "concat('About this chapter: ', p_size)"]) + " AS text FROM {part}"


@query(f"""SELECT id, c AS category, c = 'normative code text' AS blocker, c NOT IN ('header/footer/navigation', 'non-normative source artifact', 'commentary/user note') AS review FROM (SELECT id, CASE WHEN nav THEN 'header/footer/navigation' WHEN text LIKE 'https://%' THEN 'non-normative source artifact' WHEN text LIKE 'User note%' OR text LIKE 'About this chapter%' THEN 'commentary/user note' WHEN head THEN 'unresolved provenance'
WHEN tab THEN 'malformed table residue' WHEN same > 1 THEN 'duplicated text' WHEN text LIKE '####%' THEN 'genuinely unparseable content' ELSE 'normative code text' END AS c FROM ({plain(_UNMATCHED)}))""")
def unmatched_kinds(spark, d):
    x = rules.unmatched_kind(F.col("text"), F.col("nav"), F.col("head"), F.col("tab"), F.col("same"), audit.unparseable(F.col("text")))
    return sql(spark, d, _UNMATCHED).select("id", x.alias("x")).select("id", "x.*")


_MIXED = "SELECT p_partkey AS block_id, 'paragraph' AS block_type, " + choose("p_partkey", ["concat('305.', p_size, ' Supports hold')", "concat('See above. [M] 305.', p_size, ' Supports hold')", "concat('As in Section 305.', p_size, ' Supports hold')", "concat('text INSIGHTS (', p_size, ')')", "concat('INSIGHTS (', p_size, ')')", "concat('and 305.', p_size, ' lower')"]) + " AS text FROM {part}"


@query(f"""SELECT block_id, CASE WHEN bad THEN 'unparsed' ELSE 'paragraph' END AS block_type, CASE WHEN bad THEN 'mixed structural content' END AS failure FROM (SELECT block_id, (contains(text, 'INSIGHTS (') AND NOT starts_with(text, 'INSIGHTS')) OR regexp_matches(regexp_replace(text, '(?i)(section|table|chapter)s? \\d+\\.\\d+', '', 'g'), '.\\d{{3,4}}(\\.\\d+)+\\s+[A-Z][a-z]') AS bad FROM ({plain(_MIXED)}))""")
def mixed_blocks(spark, d):
    return structure.reclassified(sql(spark, d, _MIXED))


_QUESTIONS = "SELECT c_custkey AS id, " + choose("c_custkey", ["concat('Is a furnace ', c_nationkey, ' allowed in Section 303')", "concat('what are ', lower(t), 's?')", "concat('Who won match ', c_nationkey)", "'Which sections have no evidence? '", "NULL", "concat('Please explain the ', t, ' in simple terms!')", "concat('What can you do in section 30', c_nationkey % 10, '.1')", "concat('How is a ', t, ' fitted')"]) + " AS q, t FROM (SELECT c_custkey, c_nationkey, " + choose("c_nationkey", ["'Heat pump'", "'Duct'", "'Thermostat'", "'Air filter'"]) + " AS t FROM {customer}) AS c"


@query(f"""SELECT id, k IN (0, 6) OR (k IN (1, 5, 7) AND t = 'Duct' AND k <> 1) AS regulatory, CASE WHEN k IN (1, 5) THEN 'answer' WHEN k IN (0, 6, 7) THEN 'retrieve' ELSE 'out_of_scope' END AS action, CASE WHEN k IN (1, 5) THEN lower(t) END AS topic,
CASE WHEN q IS NULL THEN 'empty' WHEN NOT regexp_full_match(q, '[\\w\\s-]+') THEN 'invalid characters' END AS name_problem, CASE WHEN k = 3 THEN 'no source' ELSE 'other' END AS failure FROM (SELECT id, id % 8 AS k, q, t FROM ({plain(_QUESTIONS)}))""")
def question_rules(spark, d):
    route = rules.topic_route(F.col("q"))
    return sql(spark, d, _QUESTIONS).select("id", rules.regulatory(F.col("q")).alias("regulatory"), route["action"].alias("action"), route["topic"].alias("topic"), rules.name_problem(F.col("q")).alias("name_problem"), rules.failure_kind(F.col("q")).alias("failure"))


_SENTENCES = "SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size END AS page, CASE WHEN p_size % 2 > 0 THEN 4 END AS repaired, " + choose("p_size", ["'text'", "'Footnote'"]) + " AS label, " + choose("p_partkey", ["concat('Not permitted because of frost ', p_size, '. See below')", "concat('User note: allowed provided that it is dry ', p_size, '.')", "concat('kept to avoid loss ', p_size)", "concat('plain ', p_size)", "concat('SOURCE: ', p_size)", "concat('if buried ', p_size, '. Due to wind ', p_size, '.')"]) + " AS s FROM {part}"


@query(f"""SELECT id, CASE k WHEN 0 THEN 'of frost ' || n WHEN 2 THEN 'loss ' || n WHEN 5 THEN 'wind ' || n ELSE '' END AS reason, CASE k WHEN 1 THEN 'it is dry ' || n WHEN 5 THEN 'buried ' || n ELSE '' END AS condition,
CASE WHEN k = 1 THEN 'UserNote' WHEN k = 4 THEN 'SourceArtifact' WHEN label = 'Footnote' THEN 'Commentary' ELSE 'NormativeSectionContent' END AS class, CASE WHEN page IS NOT NULL THEN 'canonical' WHEN repaired IS NOT NULL THEN 'reconciled' ELSE 'quarantine' END AS provenance
FROM (SELECT s.*, id % 6 AS k, p_size AS n FROM ({plain(_SENTENCES)}) AS s JOIN part ON p_partkey = id)""")
def sentence_rules(spark, d):
    rows = sql(spark, d, _SENTENCES)
    return rows.select("id", rules.reason(F.col("s")).alias("reason"), rules.condition(F.col("s")).alias("condition"), rules.content_class(F.col("s"), F.col("label")).alias("class"), rules.provenance(F.col("page"), F.col("s"), F.col("repaired")).alias("provenance"))


# --- structure ------------------------------------------------------------------------------------------------------

_TABLES = "SELECT s_suppkey DIV 4 AS doc_id, s_suppkey AS table_id, concat(300 + s_suppkey % 40, CASE WHEN s_suppkey % 2 = 0 THEN '(1)' ELSE '.3' END) AS number, s_suppkey % 97 AS at FROM {supplier}"
_SECTIONS = "SELECT c_custkey DIV 60 AS doc_id, concat(300 + c_custkey % 40, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('.', c_custkey % 9) END) AS number, c_custkey % 89 AS at FROM {customer}"


@query(f"""SELECT doc_id, table_id, number, section FROM (SELECT t.doc_id, table_id, t.number, s.number AS section, row_number() OVER (PARTITION BY t.doc_id, table_id ORDER BY CASE WHEN s.number IS NULL THEN 2 WHEN k = s.number OR starts_with(k, s.number || '.') OR starts_with(s.number, k || '.') THEN 0 WHEN s.at <= t.at THEN 1 ELSE 2 END, abs(s.at - t.at), s.number) AS rn
FROM (SELECT *, split_part(number, '(', 1) AS k FROM ({plain(_TABLES).replace('DIV', '//')})) AS t LEFT JOIN ({plain(_SECTIONS).replace('DIV', '//')}) AS s ON s.doc_id = t.doc_id) WHERE rn = 1""")
def table_sections(spark, d):
    return structure.table_sections(sql(spark, d, _TABLES), sql(spark, d, _SECTIONS))


_BLOCKS = "SELECT p_partkey AS block_id, concat('Lead ', p_size, '. ', CASE WHEN p_partkey % 3 > 0 THEN '305.1 Supports hold. ' ELSE '' END, CASE WHEN p_partkey % 2 > 0 THEN '305.2 Spacing is wide.' ELSE '' END) AS text FROM {part}"


@query("SELECT p_partkey AS block_id, CASE WHEN p_partkey % 3 > 0 THEN '305.1 Supports hold.' ELSE trim('Lead ' || p_size || '. ' || CASE WHEN p_partkey % 2 > 0 THEN '305.2 Spacing is wide.' ELSE '' END) END AS text FROM part")
def owned_span(spark, d):
    return sql(spark, d, _BLOCKS).select("block_id", structure.owned_text(F.col("text"), F.lit("305.1 Supports"), F.array(F.lit("305.2 Spacing"))).alias("text"))


@query("""SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY o) - 1 AS INTEGER) AS part, heading, text FROM (SELECT p_partkey AS block_id, 0 AS o, NULL AS heading, 'Lead ' || p_size || '.' AS text FROM part UNION ALL SELECT p_partkey, 1, '305.1 Supports', '305.1 Supports hold.' FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 2, '305.2 Spacing', '305.2 Spacing is wide.' FROM part WHERE p_partkey % 2 > 0)""")
def split_at_headings(spark, d):
    heads = F.array(F.lit("305.2 Spacing"), F.lit("305.1 Supports"), F.lit("305.1"))
    return structure.split_at_headings(sql(spark, d, _BLOCKS).withColumn("headings", heads))


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey % 4 AS m FROM part) SELECT k AS line_id, 't' || k AS target_id, round(0.56 + 0.18 + CASE m WHEN 0 THEN 0.1 + 0.08 WHEN 1 THEN 0.1 * 0.6 WHEN 2 THEN 0.1 * 0.25 ELSE 0 END + 0.24 + CASE WHEN k % 2 = 0 THEN 0.08 ELSE 0 END, 6)::DOUBLE AS score FROM t WHERE k % 5 > 0""")
def span_match_full(spark, d):
    """Lines that stand word for word in the target of their section, some pages away; one in five lies in no target."""
    lines = sql(spark, d, "SELECT p_partkey AS line_id, p_partkey AS section, 10 AS page, CASE WHEN p_partkey % 5 > 0 THEN concat('alpha', p_size, ' beta gamma', p_partkey) ELSE 'none of it here' END AS text, named_struct('left', 0D, 'top', 0D, 'right', 10D, 'bottom', 10D) AS box FROM {part}")
    targets = sql(spark, d, "SELECT concat('t', p_partkey) AS target_id, p_partkey AS section, 0 AS ord, CAST(10 + p_partkey % 4 AS INT) AS t_page, concat('x Alpha', p_size, ' beta gamma', p_partkey, ' y') AS target, named_struct('left', 0D, 'top', 0D, 'right', 10D, 'bottom', 20D) AS t_box, p_partkey % 2 = 0 AS body FROM {part}")
    return audit.placed_matches(lines, targets).select("line_id", "target_id", "score")


# --- inventory ------------------------------------------------------------------------------------------------------

_SOURCE = "SELECT o_custkey AS doc_id, o_orderkey AS line_index, CAST(o_orderkey % 11 AS INT) AS page, CAST(" + choose("o_orderkey", ["18", "14", "12", "10"]) + " AS DOUBLE) AS max_font_size, array(CAST(" + choose("o_custkey", ["20", "4"]) + " AS INT)) AS flags, " + choose("o_orderkey DIV 2", ["concat('SECTION 3', 10 + o_orderkey % 7, ' PIPING.')", "concat('[M] 305.', o_orderkey % 13, ' Hangers')", "concat('TABLE 305.', o_orderkey % 5, '(1) SPACING')", "concat('see TABLE ', o_orderkey % 5)", "concat('Use Equation ', o_orderkey % 4, ' - 1 here')", "concat('Eq. ', o_orderkey % 3, '-2 again')"]) + " AS text FROM {orders}"
_SOURCE_DUCK = plain(_SOURCE).replace("DIV", "//").replace("array(CAST(", "list_value(CAST(")
_SEEN = f"""s AS (SELECT *, regexp_replace(text, '^\\[[A-Z]+\\] ', '') AS p FROM ({_SOURCE_DUCK})),
h AS (SELECT doc_id, line_index, page, CASE WHEN p LIKE 'SECTION%' AND max_font_size >= 16 THEN 'top_level_section' WHEN regexp_matches(p, '^\\d+\\.\\d+ ') AND max_font_size >= 13 AND (max_font_size >= 16 OR list_contains(flags, 20)) THEN 'numbered_section' END AS kind,
  CASE WHEN p LIKE 'SECTION%' THEN split_part(p, ' ', 2) ELSE split_part(p, ' ', 1) END AS number, CASE WHEN p LIKE 'SECTION%' THEN 'PIPING' ELSE 'Hangers' END AS title FROM s)"""


@query(f"""WITH {_SEEN}, f AS (SELECT DISTINCT ON (doc_id, number, title) * FROM h WHERE kind IS NOT NULL ORDER BY doc_id, number, title, line_index), n AS (SELECT doc_id, number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(number, '.'), lambda x: CAST(x AS INTEGER))) AS INTEGER) AS place FROM (SELECT DISTINCT doc_id, number FROM f))
SELECT f.doc_id, f.number, title, kind, page, place FROM f JOIN n ON n.doc_id = f.doc_id AND n.number = f.number""")
def source_inventory(spark, d):
    found = inventory.headings(sql(spark, d, _SOURCE))
    return found.join(inventory.numbers(found), ["doc_id", "number"]).select("doc_id", "number", "title", "kind", "page", "place")


@query(f"""WITH s AS ({_SOURCE_DUCK}), c AS (SELECT DISTINCT ON (doc_id, number, page) * FROM (SELECT doc_id, line_index, page, regexp_extract(text, '^TABLE (\\S+)', 1) AS number FROM s WHERE text LIKE 'TABLE%' AND max_font_size >= 12) ORDER BY doc_id, number, page, line_index)
SELECT doc_id, number, 'SPACING' AS title, line_index, lead(line_index) OVER (PARTITION BY doc_id ORDER BY line_index) AS next_line FROM c""")
def table_captions(spark, d):
    return inventory.captions(sql(spark, d, _SOURCE)).select("doc_id", "number", "title", "line_index", "next_line")


@query(f"""SELECT doc_id, number, page, context FROM (SELECT DISTINCT ON (doc_id, number) doc_id, page, text AS context, regexp_extract(text, '(Equation|Eq\\.) (\\d+)', 2) || '-' || CASE WHEN text LIKE 'Use%' THEN '1' ELSE '2' END AS number, line_index FROM ({_SOURCE_DUCK}) WHERE text LIKE 'Use Eq%' OR text LIKE 'Eq.%' ORDER BY doc_id, number, line_index)""")
def equation_inventory(spark, d):
    return inventory.equations(sql(spark, d, _SOURCE)).select("doc_id", "number", "page", "context")


@query("""WITH p AS (SELECT c_custkey AS t, 0 AS k, 0 AS n, c_name AS text FROM customer UNION ALL SELECT o_custkey, 1, o_orderkey, trim(CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END) || ' | ' || o_orderstatus FROM orders UNION ALL SELECT c_custkey, 2, 0, 'Footnote: ' || c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT t AS table_id, CAST(row_number() OVER (PARTITION BY t ORDER BY k, n, text) AS INTEGER) AS ordinal, text FROM p""")
def table_records(spark, d):
    rows = sql(spark, d, "SELECT o_custkey AS table_id, CAST(o_orderkey AS INT) AS row_index, array(CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END, o_orderstatus) AS cells FROM {orders} UNION ALL SELECT o_custkey, 0, array(' ', NULL) FROM {orders}")
    return inventory.table_records(sql(spark, d, "SELECT c_custkey AS table_id, c_name AS title FROM {customer}"), rows, sql(spark, d, "SELECT c_custkey AS table_id, 0 AS n, c_mktsegment AS note FROM {customer} WHERE c_custkey % 2 = 0"))


_SECTIONED = "SELECT p_partkey AS doc_id, concat('305 GENERAL\nAll of ', p_size, '.\n305.1 Supports.\n', CASE WHEN p_partkey % 3 = 0 THEN repeat(concat('kept ', p_size, ' '), 400) ELSE 'Hangers shall be kept.' END, '\n12 no', CASE WHEN p_partkey % 2 = 0 THEN concat('\n305.', p_size, ' Again\nx') ELSE '' END) AS text FROM {part}"


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS ordinal, number, title, CAST(CASE WHEN contains(number, '.') THEN 2 ELSE 1 END AS INTEGER) AS level FROM (SELECT p_partkey AS doc_id, 1 AS o, '305' AS number, 'GENERAL' AS title FROM part UNION ALL SELECT p_partkey, 2, '305.1', 'Supports.' FROM part UNION ALL SELECT p_partkey, 3, '305.' || p_size, 'Again' FROM part WHERE p_partkey % 2 = 0 AND p_size <> 1)""")
def heading_scan(spark, d):
    return E.headings(sql(spark, d, _SECTIONED))


@query("""WITH b AS (SELECT p_partkey AS doc_id, p_partkey % 2 = 0 AS more, p_size, CASE WHEN p_partkey % 3 = 0 THEN repeat('kept ' || p_size || ' ', 400) ELSE 'Hangers shall be kept.' END || chr(10) || '12 no' AS body FROM part)
SELECT doc_id, '305' AS number, 'All of ' || p_size || '.' AS content FROM b UNION ALL SELECT doc_id, '305.1', CASE WHEN NOT more THEN substr(body, 1, 2000) WHEN p_size = 1 THEN body || chr(10) || 'x' ELSE body END FROM b UNION ALL SELECT doc_id, '305.' || p_size, 'x' FROM b WHERE more AND p_size <> 1""")
def section_contents(spark, d):
    """Sections of over 2,000 characters before another heading are whole; only a document's last is cut."""
    return E.section_contents(sql(spark, d, _SECTIONED))


_SAID = "SELECT p_partkey AS doc_id, " + choose("p_partkey", ["concat('Type ', p_size, ': gas furnaces shall not be installed in closets.')", "'Fans are permitted outdoors. Nothing else.'", "concat('A clearance of ', p_size, ' feet from closets is kept by furnaces.')", "concat('A clearance of ', p_size, ' inches from fans to closets is required.')", "'Fans are not permitted outdoors.'"]) + " AS text FROM {part}"


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'furnaces' WHEN 2 THEN 'furnaces' ELSE 'fans' END AS source, CASE p_partkey % 5 WHEN 0 THEN 'PROHIBITED_IN' WHEN 1 THEN 'PERMITTED_IN' WHEN 4 THEN 'PROHIBITED_IN' ELSE 'REQUIRES_CLEARANCE' END AS type, CASE WHEN p_partkey % 5 IN (1, 4) THEN 'outdoors' ELSE 'closets' END AS target, CAST(CASE p_partkey % 5 WHEN 2 THEN 12 * p_size WHEN 3 THEN p_size END AS INTEGER) AS inches FROM part")
def relation_extraction(spark, d):
    return E.relations(sql(spark, d, _SAID), ["furnaces", "fans"], ["closets", "outdoors"])


_NOTED = "SELECT p_partkey AS doc_id, concat('See Section 305.', p_size, ' and keep ', p_size, ' inches by NFPA ', p_size, ' of chapter 3, equation ', p_size, '-2') AS text FROM {part}"


@query(f"""WITH t AS (SELECT doc_id, text, p_size AS n FROM ({plain(_NOTED)}) JOIN part ON p_partkey = doc_id), v AS (SELECT doc_id, text, unnest([{{'kind': 'section', 'value': 'Section 305.' || n}}, {{'kind': 'value', 'value': n || ' inches'}}, {{'kind': 'standard', 'value': 'NFPA ' || n}}, {{'kind': 'chapter', 'value': 'chapter 3'}}, {{'kind': 'equation', 'value': 'equation ' || n || '-2'}}]) AS x FROM t)
SELECT doc_id, x.kind AS kind, x.value AS value, CAST(strpos(text, CASE WHEN x.kind = 'value' THEN ' ' || x.value ELSE x.value END) - CASE WHEN x.kind = 'value' THEN 0 ELSE 1 END AS INTEGER) AS start, CAST(strpos(text, CASE WHEN x.kind = 'value' THEN ' ' || x.value ELSE x.value END) - CASE WHEN x.kind = 'value' THEN 0 ELSE 1 END + length(x.value) AS INTEGER) AS "end" FROM v""")
def span_annotations(spark, d):
    return E.annotations(sql(spark, d, _NOTED))


_EXPORT = "SELECT o_custkey AS doc_id, o_orderkey AS ord, concat('#/', o_orderkey) AS self_ref, " + choose("o_orderkey", ["'text'", "'section_header'", "'list_item'", "'page_header'", "'formula'"]) + " AS label, CASE WHEN o_orderkey % 5 = 1 THEN concat(300 + o_orderkey % 50, ' General') WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE '' END AS text, CASE WHEN o_orderkey % 14 = 0 THEN 'Exception: none' END AS orig, concat('c', o_orderkey) AS content FROM {orders}"


@query(f"""WITH i AS (SELECT doc_id, ord, label, coalesce(nullif(text, ''), orig, content) AS text FROM ({plain(_EXPORT)}) WHERE ord % 11 > 0), k AS (SELECT *, CASE label WHEN 'section_header' THEN 'heading' WHEN 'page_header' THEN 'furniture' WHEN 'formula' THEN 'equation' ELSE CASE WHEN text LIKE 'Exception:%' THEN 'exception' WHEN label = 'list_item' THEN 'list' ELSE 'paragraph' END END AS block_type FROM i)
SELECT doc_id, ord, block_type, coalesce(last_value(CASE WHEN block_type = 'heading' THEN 'section:' || split_part(text, ' ', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 'section:unassigned') AS section, text FROM k""")
def export_items_routed(spark, d):
    """Items in the order of their document's body; refs to nothing, and items that the body does not name, are no blocks."""
    items = sql(spark, d, _EXPORT)
    body = sql(spark, d, "SELECT o_custkey AS doc_id, o_orderkey AS ord, concat('#/', CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE CAST(o_orderkey AS STRING) END) AS ref FROM {orders}")
    return E.routed(E.resolved(items.drop("ord", "doc_id"), body).join(body.select("doc_id", "ord"), "ord")).select("doc_id", "ord", "block_type", "section", "text")
