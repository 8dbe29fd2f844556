"""Queries of the rules on roles, routes and boundaries.

The driver's tables hold no page records, so each rule's inputs are dealt from a row's id over all values that the rule tells
apart, and texts and sizes are the row's own; the rule itself is applied whole.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.functions import roles as R
from quire.functions import text as T
from quire.plans.catalog import BARE, query, table


def dealt(values: list, n: Column) -> Column:
    """One of the values by a whole number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _dealt(values: list, n: str) -> str:
    return f"{_list(values)}[({n}) % {len(values)} + 1]"


def _in(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


BLANKS = ["unknown_blank", "intentional_blank", None]
SHOWN = [r for r in R.ROLES if r not in ("blank", "library_artifact", "digitization_notice", "back_cover", "unknown")]
ROLE_SQL = f"WITH p AS (SELECT doc_id, {_dealt(R.ROLES, 'doc_id')} AS role, {_dealt(BLANKS, 'doc_id // 20')} AS blank_kind, coalesce(length(text), 0) > 1000 AS prose FROM documents)"
BRIDGE_SQL = "CASE WHEN role = 'chapter_body' THEN 'not_applicable' WHEN role IN ('full_page_illustration', 'map') OR (role = 'blank' AND blank_kind IS DISTINCT FROM 'unknown_blank') THEN 'bridge_capable' ELSE 'bridge_blocking' END"


def _roles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", dealt(R.ROLES, F.col("doc_id")).alias("role"), dealt(BLANKS, F.floor(F.col("doc_id") / 20)).alias("blank_kind"), (F.coalesce(F.length("text"), F.lit(0)) > 1000).alias("prose"),
    )


@query("page_derivations", ROLE_SQL + f""", b AS (SELECT *, {BRIDGE_SQL} AS bridge FROM p)
SELECT doc_id, role, bridge, CASE WHEN role = 'chapter_open' THEN 'prose_anchor' WHEN role = 'chapter_body' OR (role IN ('preface', 'appendix') AND prose) THEN 'prose_continuation'
  WHEN role IN ('preface', 'appendix') THEN 'text_flow_none' WHEN role IN ('blank', 'full_page_illustration', 'map') THEN 'non_prose_bridge' ELSE 'structural_break' END AS flow,
  CASE WHEN prose THEN 'prose_anchor' WHEN bridge = 'bridge_blocking' THEN 'structural_break' WHEN role IN ('blank', 'full_page_illustration', 'map') THEN 'non_prose_bridge' ELSE 'text_flow_none' END AS scan_flow,
  role IN {_in(SHOWN)} OR prose AS content_bearing, role IN {_in(SHOWN)} AS in_output, role IN ('chapter_body', 'chapter_open', 'preface') AS in_text_flow, role IN {_in(SHOWN)} AS in_element_order FROM b""")
def page_derivations(spark, sf_dir):
    """Flow, bridge, rendering and content of each page role."""
    role, blank, prose = F.col("role"), F.col("blank_kind"), F.col("prose")
    rows = _roles(spark, sf_dir).withColumn("bridge", R.bridge_eligibility(role, blank)).withColumn("policy", R.rendering_policy(role))
    return rows.select(
        "doc_id", "role", "bridge", R.flow_role(role, prose).alias("flow"), R.scan_flow_role(role, prose, F.col("bridge")).alias("scan_flow"), R.content_bearing(role, prose).alias("content_bearing"),
        F.col("policy.include_in_default_output").alias("in_output"), F.col("policy.include_in_text_flow").alias("in_text_flow"), F.col("policy.include_in_book_element_order").alias("in_element_order"),
    )


FEATURES = ["prose", "barcode", "table", "scan_artifact", "barcode", "map", "underexposure", "binding_shadow"]


@query("feature_overlays", f"""WITH p AS (SELECT doc_id, {_list(FEATURES)}[1 : 1 + CAST(doc_id % 8 AS INTEGER)] AS f, CASE WHEN doc_id % 3 = 0 THEN ['barcode'] WHEN doc_id % 3 = 1 THEN ['stamp'] ELSE CAST([] AS VARCHAR[]) END AS o FROM documents)
SELECT doc_id, array_to_string(list_filter(f, lambda x: NOT list_contains({_list(R.OVERLAYS)}, x)), ',') AS features,
  array_to_string(o || list_filter(f, lambda x, i: list_contains({_list(R.OVERLAYS)}, x) AND NOT list_contains(o, x) AND list_position(f, x) = i), ',') AS overlays FROM p""")
def feature_overlays(spark, sf_dir):
    """Overlays found among the content features go where they belong."""
    n = F.pmod("doc_id", F.lit(3))
    overlays = F.when(n == 0, F.array(F.lit("barcode"))).when(n == 1, F.array(F.lit("stamp"))).otherwise(F.array().cast("array<string>"))
    held = F.slice(F.array(*map(F.lit, FEATURES)), F.lit(1), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", held.alias("f"), overlays.alias("o"))
    out = rows.select("doc_id", R.sanitized_features(F.col("f"), F.col("o")).alias("s"))
    return out.select("doc_id", F.array_join("s.features", ",").alias("features"), F.array_join("s.overlays", ",").alias("overlays"))


TYPES = ["body", "header", "illustration", "unknown", "footnote", "caption", "chapter_title", "page_number", "table_cell", "footer", "epigraph", "marginalia"]
LABELS = [None, "watermark", "text", "decoration", "decorative_text"]
PAGES = ["text", "map", "illustrated_page", None]
TYPED_SQL = f"WITH b AS (SELECT doc_id, source, text, {_dealt(TYPES, 'doc_id')} AS kind, {_dealt(LABELS, 'doc_id // 12')} AS label, {_dealt(PAGES, 'doc_id // 60')} AS page_type FROM documents WHERE text IS NOT NULL)"
EFFECTIVE_SQL = f"""CASE WHEN {BARE} = '' OR kind IN ('header', 'footer', 'page_number') OR coalesce(label IN {_in(R.DECORATION)}, false) THEN NULL
  WHEN kind = 'illustration' OR coalesce(page_type IN {_in(R.ILLUSTRATED)}, false) AND kind IN ('body', 'unknown', 'caption') THEN 'caption' WHEN kind = 'unknown' THEN 'other_translatable' ELSE kind END"""


def _typed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    rows = rows.withColumn("kind", dealt(TYPES, F.col("doc_id"))).withColumn("label", dealt(LABELS, F.floor(F.col("doc_id") / 12))).withColumn("page_type", dealt(PAGES, F.floor(F.col("doc_id") / 60)))
    return rows.withColumn("effective", R.effective_type(F.col("kind"), F.col("label"), F.col("text"), F.col("page_type")))


@query("effective_types", TYPED_SQL + f", e AS (SELECT doc_id, {EFFECTIVE_SQL} AS effective FROM b) SELECT doc_id, effective, effective IN {_in(R.TRANSLATABLE)} AS translatable FROM e WHERE effective IS NOT NULL")
def effective_types(spark, sf_dir):
    """The type that each block is translated as, and whether it is one of the twelve that are."""
    return _typed(spark, sf_dir).where("effective is not null").select("doc_id", "effective", R.translatable(F.col("effective")).alias("translatable"))


READY_SQL = TYPED_SQL + f""", e AS (SELECT doc_id, source, text, kind, {EFFECTIVE_SQL} AS effective, doc_id % 7 <> 3 AS ready, CASE WHEN doc_id % 11 = 5 THEN 1 ELSE 0 END AS unresolved, {BARE} AS bare FROM b),
r AS (SELECT *, coalesce(ready AND unresolved = 0 AND effective IN {_in(R.TRANSLATABLE)} AND bare <> '', false) AS eligible FROM e),
c AS (SELECT *, last_value(CASE WHEN kind = 'chapter_title' THEN doc_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS chapter FROM r)"""


def _ready(spark, sf_dir):
    rows = _typed(spark, sf_dir).withColumn("ready", F.col("doc_id") % 7 != 3).withColumn("unresolved", F.when(F.col("doc_id") % 11 == 5, 1).otherwise(0))
    fit = F.coalesce(F.col("ready") & (F.col("unresolved") == 0) & R.translatable(F.col("effective")) & (T.strip(F.col("text")) != ""), F.lit(False))
    # texts stay behind: windows move ids and flags
    slim = rows.select("doc_id", "source", "kind", "effective", "ready", fit.alias("eligible"))
    upto = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return slim.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter_title", F.col("doc_id")), True).over(upto))


@query("ready_units", READY_SQL + """, b2 AS (SELECT doc_id, lag(doc_id) OVER w AS a, lag(chapter) OVER w AS ca, lag(ready) OVER w AS ra, lead(doc_id) OVER w AS z, lead(chapter) OVER w AS cz, lead(ready) OVER w AS rz FROM c WHERE kind = 'body' WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT c.doc_id, c.effective, c.chapter, CASE WHEN ca IS NOT DISTINCT FROM c.chapter AND ra THEN a END AS context_before, CASE WHEN cz IS NOT DISTINCT FROM c.chapter AND rz THEN z END AS context_after FROM c LEFT JOIN b2 USING (doc_id) WHERE c.eligible""")
def ready_units(spark, sf_dir):
    """Blocks ready to be translated, with the body blocks beside them where those are of the same chapter and ready."""
    rows = _ready(spark, sf_dir)
    w = Window.partitionBy("source").orderBy("doc_id")
    side = lambda f: F.when(f("chapter").over(w).eqNullSafe(F.col("chapter")) & f("ready").over(w), f("doc_id").over(w))
    body = rows.where("kind = 'body'").select("doc_id", side(F.lag).alias("context_before"), side(F.lead).alias("context_after"))
    return rows.where("eligible").join(body, "doc_id", "left").select("doc_id", "effective", "chapter", "context_before", "context_after")


@query("eligible_context", READY_SQL + """ SELECT doc_id, chapter, lag(doc_id) OVER w AS context_before, lead(doc_id) OVER w AS context_after FROM c WHERE eligible AND effective = 'body' WINDOW w AS (PARTITION BY source, chapter ORDER BY doc_id)""")
def eligible_context(spark, sf_dir):
    """Neighbours among the eligible body blocks of a chapter: others are passed over."""
    w = Window.partitionBy("source", "chapter").orderBy("doc_id")
    rows = _ready(spark, sf_dir).where("eligible and effective = 'body'")
    return rows.select("doc_id", "chapter", F.lag("doc_id").over(w).alias("context_before"), F.lead("doc_id").over(w).alias("context_after"))


@query("complete_context", READY_SQL + """ SELECT doc_id, max(CASE WHEN eligible THEN doc_id END) OVER (PARTITION BY source, chapter ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id,
  min(CASE WHEN eligible THEN doc_id END) OVER (PARTITION BY source, chapter ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_id FROM c""")
def complete_context(spark, sf_dir):
    """The nearest complete block on either side in the same chapter."""
    # both ways from an end of the chapter: a frame from a row to the far end is read anew for every row
    chapter = Window.partitionBy("source", "chapter")
    upto = lambda order: chapter.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda order: F.last(F.when(F.col("eligible"), F.col("doc_id")), True).over(upto(order))
    return _ready(spark, sf_dir).select("doc_id", near(F.col("doc_id")).alias("before_id"), near(F.desc("doc_id")).alias("after_id"))


@query("parent_titles", READY_SQL + f" SELECT x.doc_id, t.doc_id AS title_id FROM c x LEFT JOIN c t ON t.doc_id = x.chapter AND t.kind IN {_in(R.TITLES)}")
def parent_titles(spark, sf_dir):
    """Each block with its chapter's title block."""
    rows = _ready(spark, sf_dir)
    titles = rows.where(F.col("kind").isin(R.TITLES)).select(F.col("doc_id").alias("chapter"), F.col("doc_id").alias("title_id"))
    return rows.join(titles, "chapter", "left").select("doc_id", "title_id")


SECTIONS = ["ch_01", "fm_list_of_illustrations", "fm_contents", "fm_front", "fm_map", "fm_half", "fm_cover", "fm_other"]
SECTION_TYPES = ["chapter", "list", "contents", "frontispiece", "map", "half_title", "cover", "preface", "title_page"]
SCAN_TEXT = "CASE WHEN page_id % 13 = 4 THEN 'Digitized  by' || chr(10) || 'MICROSOFT' ELSE coalesce(html, '') END"
ROUTE_SQL = f"""WITH u AS (SELECT page_id, {_dealt(SECTIONS, 'page_id')} AS sid, {_dealt(SECTION_TYPES, 'page_id // 8')} AS st, regexp_replace(lower({SCAN_TEXT}), '\\s+', ' ', 'g') AS t FROM pages),
a AS (SELECT *, {' OR '.join(f"contains(t, '{m}')" for m in R.SCAN_MARKS)} AS artifact FROM u),
r AS (SELECT *, CASE WHEN sid LIKE 'ch\\_%' ESCAPE '\\' THEN 1 WHEN artifact THEN 2 WHEN sid = 'fm_list_of_illustrations' THEN 3 WHEN sid = 'fm_contents' THEN 4 WHEN st IN ('frontispiece', 'map') THEN 5 WHEN st IN ('half_title', 'title_page') THEN 6 WHEN st = 'cover' THEN 7 ELSE 8 END AS rule FROM a),
d AS (SELECT page_id, sid, st, CASE rule WHEN 1 THEN 'chapter_body' ELSE 'front_matter' END AS section_family,
  ['frozen_body', 'non_translatable_artifact', 'superseded_provenance', 'navigation_generated', 'reuse_existing', 'reuse_existing', 'reuse_existing', 'reuse_existing'][rule] AS translation_policy,
  ['render_existing', 'omit_from_reading', 'render_from_structured_object', 'generated_navigation', 'render_from_structured_object', 'render_from_structured_object', 'evidence_only', 'render_existing'][rule] AS render_policy,
  [NULL, NULL, 'lo_illustration_list_0021_0022', 'generated_contents_navigation', 'canonical_' || st || '_object', 'book_metadata_title_page', 'source_cover_object', NULL][rule] AS replacement_object_id,
  ['active_frozen', 'artifact', 'superseded', 'navigation_source', 'structured_visual_source', 'structured_title_source', 'cover_source', 'active_reused'][rule] AS provenance_status FROM r)"""


def _routes(spark, sf_dir):
    text = F.when(F.col("page_id") % 13 == 4, "Digitized  by\nMICROSOFT").otherwise(F.coalesce("html", F.lit("")))
    rows = table(spark, sf_dir, "pages").select("page_id", dealt(SECTIONS, F.col("page_id")).alias("sid"), dealt(SECTION_TYPES, F.floor(F.col("page_id") / 8)).alias("st"), text.alias("t"))
    return rows.select("page_id", "sid", "st", R.route_policy(F.col("sid"), F.col("st"), F.col("t")).alias("r")).select("page_id", "sid", "st", "r.*")


@query("section_routes", ROUTE_SQL + " SELECT page_id, section_family, translation_policy, render_policy, replacement_object_id, provenance_status FROM d")
def section_routes(spark, sf_dir):
    """The route of every unit by the first rule that holds."""
    return _routes(spark, sf_dir).drop("sid", "st")


@query("routed_units", ROUTE_SQL + f""", k AS (SELECT doc_id, {_dealt(['body', 'chapter_title', 'footnote', 'section_title'], 'doc_id')} AS kind, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS t FROM documents)
SELECT sid AS section, translation_policy, count(*) AS units, count(*) FILTER (kind NOT IN {_in(R.TITLES)} AND render_policy = 'render_existing' AND NOT ({' OR '.join(f"contains(t, '{m}')" for m in R.SCAN_MARKS)})) AS rendered FROM k JOIN d ON d.page_id = k.doc_id GROUP BY sid, translation_policy""")
def routed_units(spark, sf_dir):
    """Units joined with their routes: how many there are and how many are rendered: no headings, no marks of digitisation."""
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), dealt(["body", "chapter_title", "footnote", "section_title"], F.col("doc_id")).alias("kind"), R.scan_artifact(F.coalesce("text", F.lit(""))).alias("mark"))
    joined = units.join(_routes(spark, sf_dir), "page_id")
    shown = ~F.col("kind").isin(R.TITLES) & (F.col("render_policy") == "render_existing") & ~F.col("mark")
    return joined.groupBy(F.col("sid").alias("section"), "translation_policy").agg(F.count("*").alias("units"), F.count_if(shown).alias("rendered"))


STATUSES = ["completed", "schema_failed", "pending"]
JOINS = ["no_join", "concatenate_with_space", "concatenate_without_space", "uncertain"]
HYPHENS = ["line_break_hyphen", "lexical_hyphen", "none"]
FLAGS = [True, False, None]
TOKENS = ["the", "river", "Of", "whose"]
#: Mixed radix: every combination of values occurs among 36,000 line items.
BOUNDARY_SQL = f"""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS l, l_orderkey * 7 + l_linenumber AS x FROM lineitem),
b AS (SELECT k, l, {_dealt(STATUSES, 'x // 12')} AS ms, {_dealt(['none', *R.BREAKS], 'x')} AS sb, {_dealt(JOINS, 'x // 5')} AS jo, {_dealt(HYPHENS, 'x // 36')} AS ht,
  [true, false, NULL][(x // 2) % 3 + 1] AS w, [true, false, NULL][(x // 3) % 3 + 1] AS s, [true, false, NULL][(x // 7) % 3 + 1] AS p, x % 4 = 1 AS hy, {_dealt(TOKENS, 'x // 11')} AS lt,
  {_dealt(['reviewed', 'unresolved'], 'x // 13')} AS st, {_dealt(['not_required', 'required'], 'x // 17')} AS hr, x % 9 <> 2 AS av, CASE WHEN x % 10 = 3 THEN 'fragment_missing_1' ELSE 'f' || x END AS pf, CASE x % 8 WHEN 1 THEN NULL WHEN 2 THEN 'fragment_missing_2' ELSE 'g' || x END AS nf FROM n)"""


def _boundaries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("x"))
    by = lambda values, d: dealt(values, F.floor(F.col("x") / d))
    x = F.col("x")
    made = F.struct(
        by(STATUSES, 12).alias("model_status"), by(["none", *R.BREAKS], 1).alias("structural_break"), by(JOINS, 5).alias("join_operation"), by(HYPHENS, 36).alias("hyphen_type"),
        by(FLAGS, 2).alias("word_continuation"), by(FLAGS, 3).alias("sentence_continuation"), by(FLAGS, 7).alias("paragraph_continuation"), (x % 4 == 1).alias("visible_trailing_hyphen"), by(TOKENS, 11).alias("left_token"),
        by(["reviewed", "unresolved"], 13).alias("status"), by(["not_required", "required"], 17).alias("human_review_status"), (x % 9 != 2).alias("next_page_available"),
        F.when(x % 10 == 3, "fragment_missing_1").otherwise(F.concat(F.lit("f"), x)).alias("previous_fragment_id"),
        F.when(x % 8 == 1, None).when(x % 8 == 2, "fragment_missing_2").otherwise(F.concat(F.lit("g"), x)).alias("next_fragment_id"),
    )
    return rows.select("k", "l", made.alias("b"))


@query("pair_resolutions", BOUNDARY_SQL + f""", c AS (SELECT *, ms = 'completed' AND sb = 'none' AND coalesce(s, false) AND coalesce(p, false) AS run FROM b),
r AS (SELECT k, l, sb, CASE WHEN sb IN {_in(R.BREAKS)} AND jo = 'no_join' THEN 1 WHEN run AND NOT hy AND jo IN ('concatenate_with_space', 'concatenate_without_space') THEN 2 WHEN run AND hy AND coalesce(w, false) AND jo = 'concatenate_without_space' THEN 3
  WHEN run AND hy AND ht = 'line_break_hyphen' THEN 3 WHEN run AND hy AND ht = 'lexical_hyphen' THEN 4 WHEN ms = 'completed' AND sb = 'paragraph_break' AND coalesce(s, false) AND NOT coalesce(p, true) AND NOT hy AND lower(lt) IN {_in(R.FUNCTION_WORDS)} THEN 2 END AS rule FROM c)
SELECT k, l, CASE WHEN rule = 1 THEN sb ELSE 'none' END AS structural_break, ['no_join', 'insert_space', 'remove_layout_hyphen', 'preserve_lexical_hyphen'][rule] AS join_operation, rule > 2 AS word_continuation, rule > 1 AS sentence_continuation, rule > 1 AS paragraph_continuation FROM r WHERE rule IS NOT NULL""")
def pair_resolutions(spark, sf_dir):
    """Boundaries that the evidence of a pair of pages settles, function words before a supposed paragraph's end included."""
    return _boundaries(spark, sf_dir).select("k", "l", R.pair_resolution(F.col("b")).alias("r")).where("r is not null").select("k", "l", "r.*")


@query("boundary_predicates", BOUNDARY_SQL + """ SELECT k, l, coalesce(p, false) AND sb = 'none' AND jo IN ('concatenate_without_space', 'concatenate_with_space') AND hr = 'not_required' AND st = 'reviewed' AS safe_merge,
  coalesce(st = 'unresolved' AND av AND nf IS NOT NULL AND pf NOT LIKE 'fragment_missing_%' AND nf NOT LIKE 'fragment_missing_%', false) AS pair_candidate FROM b""")
def boundary_predicates(spark, sf_dir):
    return _boundaries(spark, sf_dir).select("k", "l", R.safe_merge(F.col("b")).alias("safe_merge"), F.coalesce(R.pair_candidate(F.col("b")), F.lit(False)).alias("pair_candidate"))


@query("triple_review", BOUNDARY_SQL + """, q AS (SELECT *, ms = 'schema_failed' OR w IS NULL OR s IS NULL OR p IS NULL OR jo = 'uncertain' AS open, sb <> 'none' AND jo IN ('concatenate_without_space', 'concatenate_with_space') AS odd FROM b)
SELECT k, l, CASE WHEN open THEN 0 WHEN odd THEN 1 ELSE 2 END AS priority FROM q WHERE open OR k % 10 = 0 ORDER BY 3, k, l LIMIT 200""")
def triple_review(spark, sf_dir):
    """The 200 boundaries to be reviewed first: unresolved ones, then contradictory ones named beside them, then others named."""
    b = F.col("b")
    unresolved = (b["model_status"] == "schema_failed") | b["word_continuation"].isNull() | b["sentence_continuation"].isNull() | b["paragraph_continuation"].isNull() | (b["join_operation"] == "uncertain")
    odd = (b["structural_break"] != "none") & b["join_operation"].isin("concatenate_without_space", "concatenate_with_space")
    rows = _boundaries(spark, sf_dir).select("k", "l", unresolved.alias("open"), odd.alias("odd")).where("open or k % 10 = 0")
    return rows.select("k", "l", F.when(F.col("open"), 0).when(F.col("odd"), 1).otherwise(2).alias("priority")).orderBy("priority", "k", "l").limit(200)


@query("pending_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def pending_queue(spark, sf_dir):
    """Pending units of given types in their order; a limit of none or nought is no limit."""
    return queued(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", F.col("o_orderpriority"), ["1-URGENT", "3-MEDIUM"], 100, "o_orderdate", "o_orderkey").select("o_orderkey")


def queued(rows, pending: Column, kind: Column, kinds: list[str] | None, limit: int | None, *order: str):
    out = rows.where(pending if not kinds else pending & kind.isin(kinds)).orderBy(*order)
    return out.limit(limit) if limit else out


@query("language_whitelist", f"SELECT doc_id, CASE WHEN lang IN {_in(R.LANGUAGES)} THEN lang END AS language, {_dealt([*R.LANGUAGES, 'auto', 'xx'], 'doc_id')} IN {_in([*R.LANGUAGES, 'auto'])} AS accepted FROM documents")
def language_whitelist(spark, sf_dir):
    named = dealt([*R.LANGUAGES, "auto", "xx"], F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", R.known_language(F.col("lang")).alias("language"), R.known_language(named, True).isNotNull().alias("accepted"))
