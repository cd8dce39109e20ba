"""Records between the stages: evidence blocks, provenance, targets, parameters, sessions, caches, and checks on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import rules
from skarn.functions.text import collapse, stable_id
from skarn.operators.structure import owned_text
from skarn.sources.shared import written
from skarn.sources.shipping import ship

# Content classes that are no evidence, markers that are none alone, and the labels that make a heading.
EXCLUDED_CLASSES = ("insights", "commentary", "usernote", "sourcenavigation", "sourceartifact")
EMPTY_MARKERS = ("exception:", "[bs]", "[bf]")
HEADING_LABELS = ("section_header", "title")
SECTION_NUMBER = r"^\d{3,4}(\.\d+)*$"
RESUMABLE = {"reasoning": ("type", "id", "summary", "encrypted_content", "content"), "function_call": ("type", "call_id", "name", "arguments", "id"), "function_call_output": ("type", "call_id", "output")}
RESUMABLE_OTHERS = ("type", "id", "role", "content", "name", "arguments", "call_id")


# --- evidence ---


def allowed_evidence(blocks: DataFrame) -> DataFrame:
    """blocks (block_id, content_class, block_type, text, number, others, fallback) that may be cited, with their text.

    Notes, commentary and navigation are left out, as are table references. An exception shorter than its section's
    complete one (fallback) is replaced by that, and an unparsed piece of the same exception is left out.
    Texts are cut to what their own section (number) has, up to the heading of another one.
    """
    kind, plain = F.lower(F.coalesce("content_class", F.lit(""))), collapse(F.coalesce("text", F.lit("")))
    low, block = F.lower(plain), F.lower(F.coalesce("block_type", F.lit("")))
    exception = (block == "exception") | F.startswith(kind, F.lit("exception"))
    repeated = (block == "unparsed") & F.col("fallback").isNotNull() & (F.startswith(low, F.lit("exception")) | F.startswith(plain, F.lit(",")) | F.startswith(plain, F.lit("provided")))
    noise = kind.isin(*EXCLUDED_CLASSES) | F.contains(low, F.lit("insights")) | F.startswith(low, F.lit("user note"))
    whole = F.when(exception & (F.length(plain) < F.length("fallback")), F.col("fallback")).otherwise(plain)
    kept = blocks.where((plain != "") & ~noise & ~((block == "table_ref") & ~exception) & ~F.coalesce(repeated, F.lit(False))).withColumn("text", whole)
    cut = kept.withColumn("text", owned_text(F.col("text"), F.col("number"), F.col("others")))
    return cut.where((F.col("text") != "") & ~F.lower("text").isin(*EMPTY_MARKERS)).select("block_id", F.trim(F.regexp_replace("text", r"^\[(?:BS|BF)\]\s*", "")).alias("text"))


def compact_evidence(blocks: DataFrame) -> DataFrame:
    """Evidence blocks with the fields that are sent on; those unassigned or empty are dropped."""
    text = F.trim(F.coalesce("source_text", F.lit("")))
    number = F.coalesce(F.col("section_number").cast("string"), F.lit(""))
    fields = [F.coalesce(F.col("evidence_id").cast("string"), F.lit("")).alias("evidence_id"), number.alias("section_number"), F.coalesce("section_title", F.lit("")).alias("section_title"), "page", text.alias("source_text")]
    return blocks.where((number != "unassigned") & (text != "")).select(*fields)


def without_foreign_formulas(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """blocks (section, block_id, text) without those whose text is a formula that only other sections own (section, formula)."""
    key = F.lower(F.regexp_replace("text", r"(?U)\s+", ""))
    owned = formulas.select(F.lower(F.regexp_replace("formula", r"(?U)\s+", "")).alias("key"), F.col("section").alias("owner")).distinct()
    # One row a formula and section; a block meets its own section's row, or the formula's row of any section.
    own = owned.select("key", F.col("owner").alias("section"), F.lit(True).alias("mine"))
    some = owned.select("key").distinct().withColumn("known", F.lit(True))
    both = blocks.withColumn("key", key).join(own, ["key", "section"], "left").join(some, "key", "left")
    return both.where(F.col("known").isNull() | F.col("mine").isNotNull()).select(*blocks.columns)


def first_pages(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """section, page: its own, else that of its first block (section, ord, page) that has one."""
    first = blocks.where("page is not null").groupBy("section").agg(F.min_by("page", "ord").alias("of_block"))
    return sections.join(first, "section", "left").select("section", F.coalesce("page", "of_block").alias("page"))


def candidates(ranked: DataFrame) -> DataFrame:
    """Lexical hits (number, title, page, score) in the shape of vector candidates."""
    return ranked.select(F.concat(F.lit("structural:"), "number").alias("retrieval_hash"), F.col("score").cast("double").alias("similarity"), F.lit("lexical").alias("retrieval_method"), F.struct(F.concat(F.lit("section:"), "number").alias("id"), F.col("number").cast("string").alias("number"), "title", "page").alias("section"))


# --- blocks and provenance ---


def provenance(items: DataFrame) -> DataFrame:
    """items (item_id, page, l, t, r, b, char_start, char_end, text) with a provenance struct and the names of what it lacks."""
    box = F.when(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("r").isNotNull() & F.col("b").isNotNull(), rules.box(F.struct("l", "t", "r", "b")))
    span = F.when(F.col("char_start").isNotNull() & F.col("char_end").isNotNull(), F.struct("char_start", "char_end"))
    made = F.struct(F.col("page").alias("page_no"), box.alias("bbox"), span.alias("charspan"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    lacks = F.array_compact(F.array(F.when(F.col("page").isNull(), "page"), F.when(box.isNull(), "bbox"), F.when(span.isNull(), "charspan")))
    return items.select("item_id", made.alias("provenance"), lacks.alias("missing"))


def content_blocks(items: DataFrame) -> DataFrame:
    """items (item_id, label, text, ord) as blocks: id, block_type, content_class, text; items without text are unparsed, with the reason."""
    text = collapse(F.coalesce("text", F.lit("")))
    exception, heading = text.rlike(r"(?i)^exceptions?\b"), F.col("label").isin(*HEADING_LABELS)
    kind = F.when(text == "", "unparsed").when(exception, "exception").when(heading, "heading").when(F.col("label") == "list_item", "list").when(F.col("label") == "formula", "equation").otherwise("paragraph")
    return items.select(stable_id("block", F.col("item_id"), F.col("label")).alias("block_id"), kind.alias("block_type"), rules.content_class(text, F.col("label")).alias("content_class"), text.alias("text"), F.when(text == "", "no text").alias("reason"))


def reattached(document: DataFrame, preserved: DataFrame, referenced: DataFrame, provenance: DataFrame) -> DataFrame:
    """Preserved blocks (id, text) that requirements still refer to (id) and the document (id) lacks, with their page (id, page).

    status tells those apart that cannot be attached: 'absent' where no block was preserved, 'no provenance' where no page is known.
    """
    asked = referenced.select("id").distinct().join(document.select("id"), "id", "left_anti")
    one = provenance.groupBy("id").agg(F.min("page").alias("page"))
    found = asked.join(preserved.select("id", "text"), "id", "left").join(one, "id", "left")
    return found.select("id", "text", "page", F.when(F.col("text").isNull(), "absent").when(F.col("page").isNull(), "no provenance").otherwise("attached").alias("status"))


def texts_by_page(blocks: DataFrame) -> DataFrame:
    """page, n, text of blocks (page, ord, text) at all depths: what an output says on each page, in order."""
    said = blocks.where(F.col("page").isNotNull() & (F.length(F.trim("text")) > 0))
    # One page's texts: as many as stand on it.
    rows = said.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("rows"))
    return rows.select("page", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def regions(tables: DataFrame) -> DataFrame:
    """page, region, table_ids of fragments (table_id, page, left, top, right, bottom): the box around all of a page's tables."""
    box = F.struct(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    return tables.groupBy("page").agg(box.alias("region"), F.array_sort(F.collect_set("table_id")).alias("table_ids"))


def numbered(sections: DataFrame) -> DataFrame:
    """number, title, parent of sections (number, title) whose number is one; the parent is the number without its last part."""
    known = sections.where(F.col("number").rlike(SECTION_NUMBER))
    parent = F.when(F.contains("number", F.lit(".")), F.regexp_replace("number", r"\.\d+$", ""))
    return known.select("number", "title", parent.alias("parent"))


# --- reconciliation ---


def targets(kinds: dict[str, DataFrame]) -> DataFrame:
    """One table of targets (kind, target_id, section, ord, text) of several kinds; rows without id or text are left out."""
    out = None
    for kind, df in kinds.items():
        one = df.select(F.lit(kind).alias("kind"), F.col("target_id").cast("string").alias("target_id"), F.col("section").cast("string").alias("section"), F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("target_id").isNotNull() & (F.length(F.trim("text")) > 0))


def reconciled(lines: DataFrame, matches: DataFrame, residual: DataFrame) -> DataFrame:
    """lines (line_id, category, blocker) with a classification.

    matched and nothing left over, matched with a residual that is kept, excluded (not a blocker), or unmatched.
    """
    both = lines.join(matches.select("line_id", F.lit(True).alias("hit")), "line_id", "left").join(residual.select("line_id", F.lit(True).alias("rest")), "line_id", "left")
    status = F.when(F.col("hit") & F.col("rest"), "matched_with_residual").when(F.col("hit"), "matched").when(~F.col("blocker"), "excluded").otherwise("unmatched")
    return both.select("line_id", "category", status.alias("classification"))


def verdict(classified: DataFrame, orphans: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row: how many lines, unmatched blockers, orphans and conflicts, and PASS if the last three are none."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = classified.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("classification") == "unmatched").alias("n_unmatched"))
    # Three rows of one number each.
    both = counts.join(F.broadcast(n(orphans, "n_orphans")), F.lit(True)).join(F.broadcast(n(conflicts, "n_conflicts")), F.lit(True))
    return both.withColumn("status", F.when(F.col("n_unmatched") + F.col("n_orphans") + F.col("n_conflicts") == 0, "PASS").otherwise("BLOCKED"))


def dependencies(evidence: DataFrame, quarantined: DataFrame) -> DataFrame:
    """case, n, n_quarantined, depends: 'none', 'partly' or 'only' of evidence (case, requirement) on quarantined ones (requirement)."""
    bad = quarantined.select("requirement").distinct().withColumn("bad", F.lit(True))
    counted = evidence.select("case", "requirement").distinct().join(bad, "requirement", "left").groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_quarantined"))
    return counted.withColumn("depends", F.when(F.col("n_quarantined") == 0, "none").when(F.col("n_quarantined") < F.col("n"), "partly").otherwise("only"))


def unique_violations(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """name, n_rows, n_keys, ok: whether the key columns of each table are unique and not null."""
    out = None
    for name, (df, keys) in tables.items():
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__known", known)
        one = per_key.agg(F.lit(name).alias("name"), F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n_rows"), F.count_if("__known").alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.col("n_rows") == F.col("n_keys"))


# --- JSON ---


def walked(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, name, value of every scalar in a JSON text, at any depth; value is text, and a JSON null has none.

    A round opens one level of all rows; rounds go on until nothing is left to open.
    """
    none = F.lit(None).cast("string")
    level = rows.select(F.col(key).alias("key"), F.try_parse_json(json).alias("v"), F.lit("$").alias("path"), none.alias("name"))
    found = None
    while True:
        kind = F.schema_of_variant("v")
        opened = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        level = written(level.where("v is not null").withColumn("inner", opened), "walk")
        scalars = level.where("not inner").select("key", "path", "name", F.expr("variant_get(v, '$', 'string')").alias("value"))
        found = scalars if found is None else found.unionByName(scalars)
        boxes = level.where("inner")
        if boxes.isEmpty():
            return found.select(F.col("key").alias(key), "path", "name", "value")
        spark = rows.sparkSession
        level = spark.sql("SELECT w.key, e.value AS v, concat(w.path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) AS path, coalesce(e.key, w.name) AS name FROM {boxes} w, LATERAL variant_explode(w.v) AS e", boxes=boxes)


def named_sections(walk: DataFrame, key: str) -> DataFrame:
    """key, number: section numbers that the scalars of a walk name, by a field's name or an id of the form section:number."""
    by_field = F.when(F.col("name").isin("section_number", "number"), F.col("value"))
    by_id = F.when(F.col("name").isin("section_id", "id") & F.startswith("value", F.lit("section:")), F.substr("value", F.lit(9)))
    return walk.select(key, F.coalesce(by_field, by_id).alias("number")).where(F.col("number").rlike(SECTION_NUMBER)).distinct()


def parameter_problem(json: Column) -> Column:
    """Why parameters in JSON are refused, or null: they must be an object of strings, numbers, booleans, nulls, lists and objects."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    strange = kind.rlike(r"\b(DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID)\b")
    return F.when(json.isNull(), "missing").when(kind.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object").when(strange, "type not allowed")


def without_nulls(json: Column, schema: str) -> Column:
    """JSON of a known schema without its null fields, at every level; lists keep their length."""
    return F.to_json(F.from_json(json, schema), {"ignoreNullFields": "true"})


def json_safe(columns: dict[str, Column]) -> Column:
    """Columns of any type as JSON: numbers, booleans and strings as they are, times in ISO form, lists and structs inside."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"})


def resumable(item: Column) -> Column:
    """An output item in JSON with the fields of its type that may be sent again; other types keep a narrow set."""
    fields = F.from_json(item, "map<string,string>")
    allowed = F.array(*[F.lit(f) for f in RESUMABLE_OTHERS])
    for kind, names in RESUMABLE.items():
        allowed = F.when(fields["type"] == kind, F.array(*[F.lit(f) for f in names])).otherwise(allowed)
    return F.to_json(F.map_filter(fields, lambda k, v: v.isNotNull() & F.array_contains(allowed, k)))


# --- sessions and caches ---


def restored(saved: DataFrame, asked: DataFrame, version: int) -> DataFrame:
    """asked (session, source_sha) with what its checkpoint (session, version, source_sha, phase, result, at) allows.

    The last checkpoint of a session counts. One of another version or of another source is refused; a finished one is
    replayed without a new run, any other is taken up at its phase; a session without one starts.
    """
    last = saved.groupBy("session").agg(F.max_by(F.struct("version", F.col("source_sha").alias("saved_sha"), "phase", "result"), "at").alias("c"))
    both = asked.join(last, "session", "left")
    action = F.when(F.col("c").isNull(), "start").when(F.col("c.version") != version, "refuse: version").when(~F.col("c.saved_sha").eqNullSafe(F.col("source_sha")), "refuse: source").when(F.col("c.result").isNotNull(), "replay").otherwise("resume")
    return both.select("session", action.alias("action"), F.when(action == "resume", F.col("c.phase")).alias("phase"), F.when(action == "replay", F.col("c.result")).alias("result"))


def current_cache(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a cache (sha, ...) that are still wanted, one a digest, in order of it within and across files."""
    one = cache.join(wanted.select("sha").distinct(), "sha", "left_semi").dropDuplicates(["sha"])
    return one.repartitionByRange("sha").sortWithinPartitions("sha")


def named_hashes(requirements: DataFrame, manifest: DataFrame) -> DataFrame:
    """requirement, sha of requirements (requirement, needs_review) that are not under review, from a manifest (requirement, sha)."""
    return requirements.where("not needs_review").select("requirement").join(manifest.select("requirement", "sha"), "requirement", "left")


# --- models of language, as callables ---


def prompts(spans: DataFrame) -> DataFrame:
    """span_id, prompt of spans (span_id, section, text): the instruction, the section and the exact text."""
    head = "Extract the requirements of this text. Quote it exactly; add nothing that it does not say.\n"
    return spans.select("span_id", F.concat(F.lit(head), F.lit("Section: "), F.coalesce("section", F.lit("unassigned")), F.lit("\nText: "), F.coalesce("text", F.lit(""))).alias("prompt"))


def grounded(responses: DataFrame, spans: DataFrame) -> DataFrame:
    """span_id, ordinal, ok, problem of responses (span_id, response: JSON list of {source_text, clause}).

    An item counts if its source text is the span's, and its clause lies in it.
    """
    items = F.from_json("response", "array<struct<source_text:string,clause:string>>")
    each = responses.join(spans.select("span_id", "text"), "span_id", "left").select("span_id", "text", F.posexplode_outer(items).alias("ordinal", "x"))
    problem = F.when(F.col("x").isNull(), "no items").when(F.col("text").isNull(), "unknown span").when(~F.col("x.source_text").eqNullSafe(F.col("text")), "other source").when(~F.coalesce(F.contains("text", F.col("x.clause")), F.lit(False)), "not in the source")
    return each.select("span_id", "ordinal", problem.isNull().alias("ok"), problem.alias("problem"))


def unfenced(answer: Column) -> Column:
    """A generated query without the fence of backticks around it, and without a closing semicolon."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?i)^```[a-z]*\s*", ""), r"\s*```$", "")
    return F.regexp_replace(F.trim(inner), r"\s*;\s*$", "")


def usage_of(response: Column) -> Column:
    """(input_tokens, output_tokens, text) of a model's response in JSON; missing counts are 0, output texts are joined."""
    x = F.from_json(response, "usage struct<input_tokens:bigint,output_tokens:bigint>, output array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    parts = F.flatten(F.transform(F.filter(F.coalesce(x["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string>>>>")), lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    zero = F.lit(0).cast("long")
    return F.struct(F.coalesce(x["usage"]["input_tokens"], zero).alias("input_tokens"), F.coalesce(x["usage"]["output_tokens"], zero).alias("output_tokens"), text.alias("text"))


def answered(cases: DataFrame, answer: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """case, answer, error of cases (case, question), by a callable that answers a list of questions; it runs on executors.

    A batch that fails is asked again one by one, so one bad question costs its own answer only.
    """
    ship(cases.sparkSession)

    def one(q: str) -> tuple[str | None, str | None]:
        try:
            return answer([q])[0], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                asked = [q or "" for q in part.column(1).to_pylist()]
                try:
                    got = [(a, None) for a in answer(asked)]
                except Exception:
                    got = [one(q) for q in asked]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["case", "answer", "error"])

    return cases.select(F.col("case").cast("long").alias("case"), F.col("question").cast("string").alias("question")).mapInArrow(run, "case long, answer string, error string")


def ablation(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """mode, n, recall, hit_rate of hits (mode, case, section, rank) against expected (case, section), for every mode and case."""
    modes = hits.select("mode").distinct()
    total = expected.groupBy("case").agg(F.count_distinct("section").alias("total"))
    found = hits.where(F.col("rank") <= k).select("mode", "case", "section").distinct().join(expected.select("case", "section").distinct(), ["case", "section"]).groupBy("mode", "case").agg(F.count(F.lit(1)).alias("found"))
    # Modes are a handful of names.
    each = total.join(F.broadcast(modes), F.lit(True)).join(found, ["mode", "case"], "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return each.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("found") / F.col("total")), 6).alias("recall"), F.round(F.avg((F.col("found") > 0).cast("int")), 6).alias("hit_rate"))


def synonyms_of(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """canonical, synonyms: all synonyms of each asked canonical (canonical), sorted; none gives an empty list."""
    every = synonyms.groupBy("canonical").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))
    return terms.select("canonical").distinct().join(every, "canonical", "left").select("canonical", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def golden(requirements: DataFrame, most_values: int = 3) -> DataFrame:
    """case_id, predicate, subject, values of requirements (requirement, predicate, subject, values): the first values only, as a case asks for."""
    return requirements.select(stable_id("case", F.col("requirement")).alias("case_id"), "predicate", "subject", F.slice("values", 1, most_values).alias("values"))

