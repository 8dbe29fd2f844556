"""Queries of the rules on layouts, reviews and releases; inputs that the driver's tables lack are dealt as in ``roles``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import releases as L
from quire.functions import roles as R
from quire.functions import text as T
from quire.operators import book, keys, merge
from quire.plans.catalog import BARE, BOOK, ORACLES, pages, query, table, texts
from quire.plans.roles import _dealt, _in, dealt

ACTIONS = ["render", "omit", "appendix"]
OBJECT_SQL = f"""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS l, l_orderkey * 7 + l_linenumber AS x FROM lineitem),
b AS (SELECT k, l, x, {_dealt([*L.OBJECT_TYPES, 'unknown'], 'x')} AS object_type, {_dealt(ACTIONS, 'x // 3')} AS reading, {_dealt(ACTIONS, 'x // 7')} AS evidence, x % 5 = 1 AS label, {_dealt(['full_page', 'region'], 'x // 2')} AS scope, CAST(x % 13 AS INTEGER) AS reading_order FROM o)"""


def _objects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("x"))
    x = F.col("x")
    by = lambda values, d: dealt(values, F.floor(x / d))
    return rows.select(
        "k", "l", "x", by([*L.OBJECT_TYPES, "unknown"], 1).alias("object_type"), by(ACTIONS, 3).alias("reading"), by(ACTIONS, 7).alias("evidence"), (x % 5 == 1).alias("label"),
        by(["full_page", "region"], 2).alias("scope"), (x % 13).cast("int").alias("reading_order"),
    )


def _profiles(objects):
    profile = F.explode(F.array(F.struct(F.lit("reading").alias("profile"), F.col("reading").alias("action")), F.struct(F.lit("evidence").alias("profile"), F.col("evidence").alias("action"))))
    return objects.withColumn("p", profile).where("p.action <> 'omit'").withColumn("profile", F.col("p.profile"))


PROFILE_SQL = OBJECT_SQL + ", p AS (SELECT *, 'reading' AS profile FROM b WHERE reading <> 'omit' UNION ALL SELECT *, 'evidence' FROM b WHERE evidence <> 'omit')"


@query("profile_objects", PROFILE_SQL + " SELECT profile, k, l, CAST(row_number() OVER (PARTITION BY profile, k ORDER BY reading_order, l) AS INTEGER) AS place FROM p")
def profile_objects(spark, sf_dir):
    """Objects that a profile shows, in reading order within their document."""
    w = Window.partitionBy("profile", "k").orderBy("reading_order", "l")
    return _profiles(_objects(spark, sf_dir)).select("profile", "k", "l", F.row_number().over(w).alias("place"))


@query("render_plan", PROFILE_SQL + " SELECT profile, object_type, count(*) AS objects, count(*) FILTER (label) AS technical_labels, count(*) FILTER (object_type = 'facsimile_region' AND scope = 'full_page') AS full_pages FROM p GROUP BY profile, object_type")
def render_plan(spark, sf_dir):
    """Counts of each profile's objects by type."""
    full = (F.col("object_type") == "facsimile_region") & (F.col("scope") == "full_page")
    return _profiles(_objects(spark, sf_dir)).groupBy("profile", "object_type").agg(F.count("*").alias("objects"), F.count_if("label").alias("technical_labels"), F.count_if(full).alias("full_pages"))


@query("object_counts", OBJECT_SQL + " SELECT object_type, count(*) AS objects FROM b GROUP BY object_type")
def object_counts(spark, sf_dir):
    return _objects(spark, sf_dir).groupBy("object_type").agg(F.count("*").alias("objects"))


@query("layout_errors", OBJECT_SQL + f""", e AS (SELECT k, l, list_filter([CASE WHEN object_type NOT IN {_in(L.OBJECT_TYPES)} THEN 'invalid object_type' END, CASE WHEN x % 17 = 3 THEN 'missing object_id' END, CASE WHEN x % 19 = 4 THEN 'missing source_pages' END, CASE WHEN x % 23 = 5 THEN 'missing orientation' END,
  CASE WHEN x % 29 = 6 THEN 'missing confidence' END, CASE WHEN x % 23 IN (5, 7) THEN 'invalid orientation' END, CASE WHEN x % 19 IN (4, 8) THEN 'source_pages must be non-empty' END, CASE WHEN x % 29 IN (6, 9) THEN 'confidence must be between 0 and 1' END, CASE WHEN x % 31 = 2 THEN 'render_policy must define reading and evidence' END], lambda v: v IS NOT NULL) AS errors FROM b)
SELECT k, l, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")
def layout_errors(spark, sf_dir):
    """Layout objects with what is wrong with them."""
    x = F.col("x")
    policy = F.when(x % 31 == 2, F.create_map(F.lit("reading"), F.col("reading"))).otherwise(F.create_map(F.lit("reading"), F.col("reading"), F.lit("evidence"), F.col("evidence")))
    made = F.struct(
        "object_type", F.when(x % 17 != 3, x).alias("object_id"), F.when(x % 19 == 4, None).when(x % 19 == 8, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("source_pages"), F.lit("0 0 1 1").alias("bbox"),
        F.when(x % 23 == 5, None).when(x % 23 == 7, 45).otherwise(90).alias("orientation"), "reading_order", F.when(x % 29 == 6, None).when(x % 29 == 9, 1.5).otherwise(0.5).alias("confidence"), F.lit("p").alias("provenance"), policy.alias("render_policy"),
    )
    out = _objects(spark, sf_dir).select("k", "l", L.layout_errors(made).alias("e")).where(F.size("e") > 0)
    return out.select("k", "l", F.array_join("e", "; ").alias("errors"))


GATE_SQL = OBJECT_SQL + f""", g AS (SELECT *, object_type IN {_in(L.TABLES)} AS tab, CASE x % 11 WHEN 3 THEN 'header' WHEN 5 THEN 'watermark' END AS kind FROM b),
c AS (SELECT k % 40 AS book, bool_and(NOT tab OR x % 41 <> 7) AS numeric_unresolved_explicit, bool_and(NOT tab OR x % 37 NOT IN (1, 2)) AS table_counts_accountable, bool_and(kind IS NULL OR reading = 'omit' OR k % 3 = 0) AS headers_footers_not_reading,
  bool_and(NOT (label AND reading <> 'omit') OR k % 2 = 0) AS reading_technical_labels_zero, bool_and(NOT (object_type = 'facsimile_region' AND scope = 'full_page' AND reading <> 'omit')) AS reading_full_page_facsimiles_zero, bool_and(NOT (tab AND (object_type = 'rotated_table' OR x % 6 = 2)) OR x % 43 <> 9) AS landscape_tables_not_clipped FROM g GROUP BY k % 40)
SELECT book, unnest(['numeric_unresolved_explicit', 'table_counts_accountable', 'headers_footers_not_reading', 'reading_technical_labels_zero', 'reading_full_page_facsimiles_zero', 'landscape_tables_not_clipped']) AS check,
  unnest([numeric_unresolved_explicit, table_counts_accountable, headers_footers_not_reading, reading_technical_labels_zero, reading_full_page_facsimiles_zero, landscape_tables_not_clipped]) AS passed FROM c"""


@query("layout_gate", GATE_SQL)
def layout_gate(spark, sf_dir):
    """The quality gate's conditions on layout objects, for each book."""
    x, k = F.col("x"), F.col("k")
    made = F.struct(
        "object_type", "reading", F.when(k % 3 == 0, None).when(x % 11 == 3, "header").when(x % 11 == 5, "watermark").alias("artifact_kind"),
        F.when(x % 41 == 7, None).otherwise("resolved").alias("numeric_status"), F.when(x % 37 == 1, None).otherwise(3).alias("column_count"), F.lit(1).alias("header_row_count"), F.lit("resolved").alias("row_count_status"), F.when(x % 37 == 2, None).otherwise(5).alias("row_count"),
        (F.col("label") & (k % 2 == 1)).alias("technical_label_visible"), F.col("scope").alias("facsimile_scope"), (x % 6 == 2).alias("wide"), F.when(x % 43 == 9, "clip").otherwise("landscape_section").alias("overflow_policy"),
    )
    rules = L.object_checks(F.col("o"))
    one = _objects(spark, sf_dir).select((k % 40).alias("book"), made.alias("o")).groupBy("book").agg(*(F.every(c).alias(name) for name, c in rules.items()))
    return one.select("book", F.stack(F.lit(len(rules)), *(v for name in rules for v in (F.lit(name), F.col(name)))).alias("check", "passed"))


@query("touching_boundaries", """WITH u AS (SELECT o_orderkey AS unit, unnest([o_orderkey, o_orderkey + 1, o_custkey]) AS f FROM orders), b AS (SELECT l_orderkey AS k, l_linenumber AS l, l_orderkey + l_linenumber AS prev, l_orderkey * 2 AS next FROM lineitem)
SELECT DISTINCT u.unit, b.k, b.l FROM u JOIN b ON u.f = b.prev OR u.f = b.next""")
def touching_boundaries(spark, sf_dir):
    """Boundaries with an end among a unit's fragments: both ends and all fragments as rows of an equi-join."""
    fragments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.explode(F.array_distinct(F.array("o_orderkey", F.col("o_orderkey") + 1, "o_custkey"))).alias("f"))
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    ends = table(spark, sf_dir, "lineitem").select(k.alias("k"), line.alias("l"), F.explode(F.array_distinct(F.array(k + line, k * 2))).alias("f"))
    return fragments.join(ends, "f").select("unit", "k", "l").distinct()


@query("mapping_gate", """WITH m AS (SELECT doc_id // 2 AS unit, doc_id % 9 AS section, doc_id % 50 = 7 AS quarantined FROM documents)
SELECT 'duplicate_unit' AS check, (SELECT count(*) FROM (SELECT unit FROM m GROUP BY unit HAVING count(*) > 1))::BIGINT AS violations UNION ALL SELECT 'invalid_section', (SELECT count(*) FROM m WHERE section NOT IN (SELECT r_regionkey FROM region)) UNION ALL SELECT 'quarantined', (SELECT count(*) FROM m WHERE quarantined)
UNION ALL SELECT 'unit_count', (SELECT abs(count(*) - (SELECT count(*) FROM documents)) FROM m)""")
def mapping_gate(spark, sf_dir):
    """Violations of the mapping gate: duplicate units, sections that are none, quarantined units, units not accounted for."""
    n = F.col("doc_id")
    units = table(spark, sf_dir, "documents").select(F.floor(n / 2).alias("unit"), (n % 9).alias("section"), (n % 50 == 7).alias("quarantined"))
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("section"), F.lit(True).alias("known"))
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    out = count(units.groupBy("unit").count().where("count > 1"), "duplicate_unit").unionByName(count(units.join(F.broadcast(known), "section", "left_anti"), "invalid_section"))
    out = out.unionByName(count(units.where("quarantined"), "quarantined"))
    expected = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    both = units.agg(F.count("*").alias("m")).join(expected)
    return out.unionByName(both.select(F.lit("unit_count").alias("check"), F.abs(F.col("m") - F.col("n")).alias("violations")))


ENTRY_SQL = f"WITH e AS (SELECT doc_id, {_dealt(['caption', 'body', 'caption', 'footnote'], 'doc_id')} AS kind, CASE doc_id % 10 WHEN 2 THEN 'Barcode of it' WHEN 4 THEN 'Copy of UNIV CALIF' WHEN 6 THEN 'Univ  Calif' ELSE coalesce(text, '') END AS t, [doc_id // 3, doc_id // 3 + 1] AS p FROM documents)"


@query("page_captions", ENTRY_SQL + f", x AS (SELECT doc_id, unnest(p) AS page_id FROM e WHERE kind = 'caption' AND NOT ({' OR '.join(f'contains(lower(t), {chr(39)}{m}{chr(39)})' for m in R.FIGURE_MARKS)})) SELECT x.page_id, x.doc_id AS caption FROM x JOIN pages USING (page_id)")
def page_captions(spark, sf_dir):
    """Captions of each page, marks of digitisation left out."""
    n = F.col("doc_id")
    # a mark of other rules, one of this rule and one spaced differently tell the rules apart
    text = F.when(n % 10 == 2, "Barcode of it").when(n % 10 == 4, "Copy of UNIV CALIF").when(n % 10 == 6, "Univ  Calif").otherwise(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").where((dealt(["caption", "body", "caption", "footnote"], n) == "caption") & ~R.figure_artifact(text))
    third = F.floor(n / 3)
    return rows.select(n.alias("caption"), F.explode(F.array(third, third + 1)).alias("page_id")).join(table(spark, sf_dir, "pages").select("page_id"), "page_id").select("page_id", "caption")


@query("caption_texts", "WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS ids, list(role ORDER BY turn) AS texts FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY conv_id) SELECT conv_id, unnest(ids) AS caption_id, unnest(texts) AS caption_text FROM g")
def caption_texts(spark, sf_dir):
    """Ids and texts kept in two arrays, paired by position."""
    held = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("g"))
    zipped = F.arrays_zip(F.col("g.turn").alias("id"), F.col("g.role").alias("text"))
    return held.select("conv_id", F.explode(zipped).alias("z")).select("conv_id", F.col("z.id").alias("caption_id"), F.col("z.text").alias("caption_text"))


@query("physical_page_order", BOOK + ", m AS (SELECT DISTINCT page_id, page_id % 4 AS section, CASE WHEN page_id % 3 > 0 THEN page_id - 5 END AS printed FROM pages) SELECT b.doc_id, b.page, coalesce(m.section::VARCHAR, '') AS section_id, m.printed AS printed_page FROM book b LEFT JOIN m ON m.page_id = b.doc_id")
def physical_page_order(spark, sf_dir):
    """Pages in order with section and printed number of their membership, in one join."""
    n = F.col("page_id")
    members = table(spark, sf_dir, "pages").select(n.alias("doc_id"), (n % 4).cast("string").alias("section"), F.when(n % 3 > 0, n - 5).alias("printed_page")).distinct()
    return pages(spark, sf_dir).join(members, "doc_id", "left").select("doc_id", "page", F.coalesce("section", F.lit("")).alias("section_id"), "printed_page")


@query("prose_flow", "WITH m AS (SELECT l_orderkey AS block, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS section FROM lineitem GROUP BY l_orderkey) SELECT doc_id, coalesce(section::VARCHAR, '') AS section_id, sha256(coalesce(text, '')) AS source_text_sha256 FROM documents LEFT JOIN m ON block = doc_id")
def prose_flow(spark, sf_dir):
    """Entries with the first section that maps them, or none."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).cast("string").alias("section"))
    return table(spark, sf_dir, "documents").join(first, "doc_id", "left").select("doc_id", F.coalesce("section", F.lit("")).alias("section_id"), keys.text_hash(F.coalesce("text", F.lit(""))).alias("source_text_sha256"))


STATES = ["validated", "translated", "pending", "failed_retryable", "failed_terminal", "stale_source", "preserve_source", "blocked_by_source_quality"]
STATE_SQL = f"WITH s AS (SELECT o_custkey % 50 AS book, o_orderkey AS unit, {_dealt(STATES, 'o_orderkey // 3')} AS status, o_orderkey % 101 <> 0 AS cached, o_orderkey % 103 <> 0 AS overlaid FROM orders)"


def _states(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("book"), n.alias("unit"), dealt(STATES, F.floor(n / 3)).alias("status"), (n % 101 != 0).alias("cached"), (n % 103 != 0).alias("overlaid"))


@query("build_statistics", STATE_SQL + " SELECT book, count(*) AS units, count(*) FILTER (status = 'pending') AS pending_source_fallback, count(*) FILTER (status = 'preserve_source') AS preserve_source, count(*) FILTER (status = 'blocked_by_source_quality') AS blocked_source_quality_fallback FROM s GROUP BY book")
def build_statistics(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return _states(spark, sf_dir).groupBy("book").agg(F.count("*").alias("units"), n("pending").alias("pending_source_fallback"), n("preserve_source").alias("preserve_source"), n("blocked_by_source_quality").alias("blocked_source_quality_fallback"))


@query("release_blockers", STATE_SQL + """, c AS (SELECT book, count(*) FILTER (status = 'pending') AS a, count(*) FILTER (status = 'failed_retryable') AS b, count(*) FILTER (status = 'failed_terminal') AS c, count(*) FILTER (status = 'stale_source') AS d,
  count(*) FILTER (status IN ('validated', 'translated') AND NOT cached) AS e, count(*) FILTER (status IN ('validated', 'translated') AND NOT overlaid) AS f FROM s WHERE book % 7 > 0 OR status IN ('validated', 'translated', 'preserve_source') GROUP BY book),
l AS (SELECT book, list_filter([CASE WHEN a > 0 THEN 'pending=' || a END, CASE WHEN b > 0 THEN 'failed_retryable=' || b END, CASE WHEN c > 0 THEN 'failed_terminal=' || c END, CASE WHEN d > 0 THEN 'stale_source=' || d END, CASE WHEN e > 0 THEN 'validated_cache_missing=' || e END, CASE WHEN f > 0 THEN 'validated_overlay_missing=' || f END,
  CASE WHEN book % 5 = 1 THEN 'manifest_state_mismatch' END, CASE WHEN book % 4 = 2 THEN 'production_checkpoint_not_completed' END], lambda v: v IS NOT NULL) AS blockers FROM c)
SELECT book, array_to_string(blockers, ' ') AS blockers, len(blockers) = 0 AS eligible FROM l""")
def release_blockers(spark, sf_dir):
    """What stands against a release: states that block, validated units without cache or overlay, manifest and checkpoint."""
    rows = _states(spark, sf_dir).where("book % 7 > 0 or status in ('validated', 'translated', 'preserve_source')")
    done = F.col("status").isin("validated", "translated")
    found = {s: F.col("status") == s for s in ("pending", "failed_retryable", "failed_terminal", "stale_source")}
    found |= {"validated_cache_missing": done & ~F.col("cached"), "validated_overlay_missing": done & ~F.col("overlaid")}
    counts = rows.groupBy("book").agg(*(F.count_if(c).alias(name) for name, c in found.items()))
    counted = [F.when(F.col(name) > 0, F.concat(F.lit(f"{name}="), F.col(name))) for name in found]
    plain = [F.when(F.col("book") % 5 == 1, F.lit("manifest_state_mismatch")), F.when(F.col("book") % 4 == 2, F.lit("production_checkpoint_not_completed"))]
    return counts.select("book", F.array_compact(F.array(*counted, *plain)).alias("b")).select("book", F.array_join("b", " ").alias("blockers"), (F.size("b") == 0).alias("eligible"))


@query("request_outcomes", "SELECT user_id, count(DISTINCT event_id) AS requests, count(*) FILTER (event_id % 4 = 0) AS validated, count(*) FILTER (event_id % 4 = 1) AS semantic_unresolved, CASE WHEN count(*) FILTER (event_id % 4 = 0) < 3 THEN 'vision_final_states_incomplete' ELSE '' END || CASE WHEN count(*) FILTER (event_id % 4 = 2) > 0 THEN ' translation_delta_pending=' || count(*) FILTER (event_id % 4 = 2) ELSE '' END AS blockers FROM events GROUP BY user_id")
def request_outcomes(spark, sf_dir):
    """Requests by outcome and what keeps a workspace from being ready."""
    n = lambda r: F.count_if(F.col("event_id") % 4 == r)
    blockers = F.concat(F.when(n(0) < 3, "vision_final_states_incomplete").otherwise(""), F.when(n(2) > 0, F.concat(F.lit(" translation_delta_pending="), n(2))).otherwise(""))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_id").alias("requests"), n(0).alias("validated"), n(1).alias("semantic_unresolved"), blockers.alias("blockers"))


@query("span_edits", """WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 60 AND doc_id % 4 < 3)
SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 10) || 'FIRST' || substr(text, 16, 25) || 'x' || substr(text, 51) ELSE text END) AS text_sha256, ['applied', 'translation_changed', 'span_changed'][doc_id % 4 + 1] AS status FROM t""")
def span_edits(spark, sf_dir):
    """Reviewed spans replaced from the last to the first, unless the text or a span is no longer what was reviewed."""
    n, t = F.col("doc_id"), F.col("text")
    rows = table(spark, sf_dir, "documents").where("length(text) >= 60 and doc_id % 4 < 3")
    edit = lambda a, b, new: F.struct(F.lit(a).alias("first"), F.lit(b).alias("end"), F.when(n % 4 == 2, "\u0001").otherwise(F.substring(t, a + 1, b - a)).alias("current"), F.lit(new).alias("replacement"))
    reviewed = F.when(n % 4 == 1, "other").otherwise(keys.text_hash(t))
    out = rows.select("doc_id", L.span_edits(t, reviewed, F.array(edit(10, 15, "FIRST"), edit(40, 50, "x"))).alias("e"))
    return out.select("doc_id", keys.text_hash(F.col("e.text")).alias("text_sha256"), "e.status")


@query("undo_target", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS application FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def undo_target(spark, sf_dir):
    """The latest application of each project that is not undone yet."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("application"))


@query("application_history", "SELECT l.l_suppkey AS package, o.o_orderkey AS application, o.o_orderdate AS applied_at, CAST(row_number() OVER (PARTITION BY l.l_suppkey ORDER BY o.o_orderdate, o.o_orderkey, l.l_linenumber) AS INTEGER) AS place FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey")
def application_history(spark, sf_dir):
    """Applications held in each package's array, as rows in order of time."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    w = Window.partitionBy("l_suppkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber")
    return items.select(F.col("l_suppkey").alias("package"), F.col("o_orderkey").alias("application"), F.col("o_orderdate").alias("applied_at"), F.row_number().over(w).alias("place"))


@query("package_list", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' ORDER BY c_name")
def package_list(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_nationkey = 7 and c_mktsegment = 'BUILDING'").orderBy("c_name").select("c_custkey", "c_name", "c_mktsegment")


CORRECTIONS = ['[{"corrected_source_text": " a "}, {"review_status": "Pending"}]', "[]", "", '[{"structure_note": "x"}, {"corrected_translated_text": ""}, {"review_status": "done"}]']


@query("object_corrections", f"SELECT doc_id, [1, 0, 0, 2][doc_id % 4 + 1]::INTEGER AS corrections FROM documents")
def object_corrections(spark, sf_dir):
    """Corrections of a review field that say something: those that only repeat the default are dropped."""
    schema = "array<struct<corrected_source_text:string,corrected_translated_text:string,structure_note:string,review_status:string>>"
    parsed = F.from_json(dealt(CORRECTIONS, F.col("doc_id")), schema)
    kept = F.filter(F.coalesce(parsed, F.array().cast(schema)), L.worth_applying)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("corrections"))


@query("provider_calls", "SELECT o_custkey, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 WHEN o_orderkey % 3 = 1 THEN 1 ELSE o_orderkey % 4 END)::BIGINT AS calls FROM orders GROUP BY o_custkey")
def provider_calls(spark, sf_dir):
    """Calls in a ledger whose older rows name units or a mock provider instead of a number."""
    n = F.col("o_orderkey")
    calls = F.when(n % 3 == 0, n % 5)
    provider, units = F.when(n % 3 == 1, "mock").otherwise("real"), F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (n % 4).cast("int"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(L.transport_calls(calls, provider, units)).alias("calls"))


@query("ocr_routes", f"""WITH p AS (SELECT doc_id, {BARE} AS bare, doc_id % 5 > 1 AS passed, {_dealt(['mock', 'glm', None], 'doc_id // 5')} AS provider, doc_id % 2 = 0 AS allowed FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN passed THEN 'python_text' WHEN provider = 'mock' THEN 'mock_vision_review' WHEN provider IS NOT NULL AND allowed THEN 'glm_vision' ELSE 'web_assist' END AS route, CASE WHEN passed OR (provider = 'glm' AND allowed) THEN 'accepted' WHEN bare <> '' THEN 'review_required' ELSE 'unresolved' END AS status FROM p""")
def ocr_routes(spark, sf_dir):
    n = F.col("doc_id")
    out = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", L.ocr_route(n % 5 > 1, dealt(["mock", "glm", None], F.floor(n / 5)), n % 2 == 0, F.col("text")).alias("r"))
    return out.select("doc_id", "r.route", "r.status")


INDEX_LINES = {"Abbot , of  Wells, 12": ("Abbot, of Wells, 12", "Abbot, of Wells", "12"), "Lead­ing , , 4, 7": ("Leading, 4, 7", "Leading, 4", "4|7"), " — No page —": ("No page", "No page", ""), "Teh river, 100 and so on and on and on to 9": ("The river, 100 and so on and on and on to 9", "The river, 100 and so on and on and on to", "9")}


@query("index_lines", f"SELECT doc_id, {_dealt([v[0] for v in INDEX_LINES.values()], 'doc_id')} AS line, {_dealt([v[1] for v in INDEX_LINES.values()], 'doc_id')} AS term, {_dealt([v[2] for v in INDEX_LINES.values()], 'doc_id')} AS refs FROM documents")
def index_lines(spark, sf_dir):
    """Index lines cleaned, and their terms and references as the early parser takes them."""
    line = L.clean_index_line(dealt(list(INDEX_LINES), F.col("doc_id")), {"Teh": "The"})
    out = table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).withColumn("e", L.early_index_entry(F.col("line")))
    return out.select("doc_id", "line", "e.term", F.array_join("e.refs", "|").alias("refs"))


@query("capped_candidates", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE length(text) > 200) WHERE n <= 500")
def capped_candidates(spark, sf_dir):
    """The first 500 candidates of each package in scan order."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 200").select("source", "doc_id")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 500").drop("n")


@query("latest_project", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey").limit(1)


@query("acknowledged_warnings", "SELECT user_id, arg_max(event_type, event_id) AS last_state, max(event_id) AS at FROM events GROUP BY user_id")
def acknowledged_warnings(spark, sf_dir):
    """An upsert by key: the last row replaces those before."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_state"), F.max("event_id").alias("at"))


@query("checkpoint_store", "SELECT event_type AS stage, count(DISTINCT user_id) FILTER (event_id % 6 > 0) AS completed, count(DISTINCT user_id) FILTER (event_id % 6 = 0) AS quarantined, count(*) AS calls FROM events GROUP BY event_type")
def checkpoint_store(spark, sf_dir):
    """Items of a stage that are completed or quarantined, each once, and calls made."""
    item, bad = F.col("user_id"), F.col("event_id") % 6 == 0
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count_distinct(F.when(~bad, item)).alias("completed"), F.count_distinct(F.when(bad, item)).alias("quarantined"), F.count("*").alias("calls"))


@query("offline_recovery", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' WHERE o.o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = o.o_orderkey AND d.l_returnflag = 'A')")
def offline_recovery(spark, sf_dir):
    """Errors with a saved raw response and no completed record: normalised again, not called again."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    errors = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    raw, done = items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'").select("o_orderkey")
    return errors.join(raw, "o_orderkey").join(done, "o_orderkey", "left_anti").select("o_orderkey", "l_linenumber")


@query("ordered_alignment", "WITH a AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (ORDER BY doc_id) AS n FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 19 = 0 THEN text || '.' ELSE text END) AS h, row_number() OVER (ORDER BY doc_id) AS m FROM documents WHERE doc_id <> 50) SELECT a.doc_id, n = m AS same_place, a.h = b.h AS same_text FROM a JOIN b USING (doc_id)")
def ordered_alignment(spark, sf_dir):
    """Units and blocks of one id: whether place and text agree. Places by ranges of ids, not by one window over all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("all"))
    other = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    a = book.numbered_pages(d.select("all", "doc_id", keys.text_hash(F.col("text")).alias("h")), "all").drop("all")
    b = book.numbered_pages(d.where("doc_id <> 50").select("all", "doc_id", keys.text_hash(other).alias("g")), "all").select("doc_id", "g", F.col("page").alias("m"))
    return a.join(b, "doc_id").select("doc_id", (F.col("page") == F.col("m")).alias("same_place"), (F.col("h") == F.col("g")).alias("same_text"))


@query("merge_preview", "SELECT d.doc_id, CASE WHEN d.doc_id % 3 > 0 THEN 'not_a_target' WHEN l.doc_id IS NULL THEN 'no_visual_result' WHEN l.quality = 0 THEN 'visual_failed' ELSE 'proposed' END AS status, CASE WHEN d.doc_id % 3 = 0 AND l.quality = 1 THEN l.toxic::BIGINT ELSE length(d.text)::BIGINT % 2 END AS role FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_preview(spark, sf_dir):
    """Page records with what a successful visual result of a target page would change, and the status of each."""
    n, q = F.col("doc_id"), F.col("quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("there")), "doc_id", "left")
    status = F.when(n % 3 > 0, "not_a_target").when(F.col("there").isNull(), "no_visual_result").when(q == 0, "visual_failed").otherwise("proposed")
    return rows.select("doc_id", status.alias("status"), F.when((n % 3 == 0) & (q == 1), F.col("toxic")).otherwise(F.col("n") % 2).cast("long").alias("role"))


@query("body_edges", "WITH b AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'assistant') SELECT conv_id, min(turn) AS first_id, left(arg_min(text, turn), 500) AS first_text, max(turn) AS last_id, right(arg_max(text, turn), 500) AS last_text FROM b GROUP BY conv_id")
def body_edges(spark, sf_dir):
    """First and last body block of a page, 500 characters of each; texts are cut before they travel."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.left("text", F.lit(500)).alias("head"), F.right("text", F.lit(500)).alias("tail"))
    return rows.groupBy("conv_id").agg(F.min("turn").alias("first_id"), F.min_by("head", "turn").alias("first_text"), F.max("turn").alias("last_id"), F.max_by("tail", "turn").alias("last_text"))


@query("reflow_diagnostics", r"SELECT source, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS input_breaks, sum(len(regexp_extract_all(text, '[0-9A-Za-z_]-\s*\n\s*[0-9A-Za-z_]')))::BIGINT AS hyphens_before FROM documents GROUP BY source")
def reflow_diagnostics(spark, sf_dir):
    """Hard line breaks and hyphens at line ends before a text is reflowed."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.count_literal(t, "\n")).alias("input_breaks"), F.sum(T.count_regex(t, r"[0-9A-Za-z_]-\s*\n\s*[0-9A-Za-z_]")).alias("hyphens_before"))


@query("render_keys", """SELECT doc_id, sha256('{"color_mode":"rgb","dpi":200,"image_format":"png","pdf_page":' || doc_id || ',"renderer":"r","renderer_version":"1","source_pdf_sha256":"' || sha256(coalesce(source, '')) || '"}') AS cache_key FROM documents""")
def render_keys(spark, sf_dir):
    """A page image's cache key: hash of what it is made from, as JSON with sorted keys."""
    made = keys.canonical_json(source_pdf_sha256=keys.text_hash(F.coalesce("source", F.lit(""))), pdf_page=F.col("doc_id"), dpi=F.lit(200), color_mode=F.lit("rgb"), image_format=F.lit("png"), renderer=F.lit("r"), renderer_version=F.lit("1"))
    return table(spark, sf_dir, "documents").select("doc_id", keys.text_hash(made).alias("cache_key"))


@query("document_terms", """WITH c AS (SELECT DISTINCT p_brand AS term, p_type AS unit FROM part), r AS (SELECT DISTINCT p_brand AS term FROM part WHERE p_size % 2 = 0) SELECT term, count(*) AS units FROM c WHERE term IN (FROM r) AND p_ok(term) GROUP BY term HAVING count(*) >= 2""".replace("p_ok(term)", "regexp_matches(term, '^[A-Z][A-Za-z#0-9]{2,}$')"))
def document_terms(spark, sf_dir):
    """Terms that stand in cells of two units at least and head a row of some table."""
    p = table(spark, sf_dir, "part")
    cells = p.where(F.col("p_brand").rlike("^[A-Z][A-Za-z#0-9]{2,}$")).select(F.col("p_brand").alias("term"), F.col("p_type").alias("unit")).distinct()
    heads = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("term")).distinct()
    return cells.join(heads, "term", "left_semi").groupBy("term").agg(F.count("*").alias("units")).where("units >= 2")


SCOPES = ["footnote", "chapter_endnote", "document_endnote"]
NOTE_SQL = f"""WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS note_id, l_suppkey % 10 AS book, l_partkey % 40 AS label, l_orderkey % 200 AS page, {_dealt(SCOPES, 'l_orderkey')} AS scope FROM lineitem WHERE l_quantity < 12),
f AS (SELECT o_orderkey AS reference, o_custkey % 10 AS book, o_orderkey % 41 AS label, o_orderkey % 200 AS page FROM orders),
j AS (SELECT f.reference, n.note_id, CASE WHEN n.scope = 'footnote' AND n.page = f.page THEN 0 WHEN n.scope = 'chapter_endnote' AND n.page >= f.page THEN 1 WHEN n.scope = 'document_endnote' THEN 2 END AS tier FROM f LEFT JOIN n USING (book, label)),
t AS (SELECT reference, min(tier) AS tier FROM j GROUP BY reference), g AS (SELECT t.reference, any_value(t.tier) AS tier, count(DISTINCT j.note_id) FILTER (j.tier = t.tier) AS n, min(j.note_id) FILTER (j.tier = t.tier) AS note FROM t JOIN j USING (reference) GROUP BY t.reference),
l AS (SELECT reference, CASE WHEN tier IS NULL THEN 'unresolved' WHEN n = 1 THEN 'linked' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 AND tier IS NOT NULL THEN note END AS note_id FROM g)"""


def _links(spark, sf_dir):
    k = F.col("l_orderkey")
    notes = table(spark, sf_dir, "lineitem").where("l_quantity < 12").select((k * 10 + F.col("l_linenumber")).alias("note_id"), (F.col("l_suppkey") % 10).alias("book"), (F.col("l_partkey") % 40).alias("label"), (k % 200).alias("page"), dealt(SCOPES, k).alias("scope"))
    o = F.col("o_orderkey")
    references = table(spark, sf_dir, "orders").select(o.alias("reference"), (F.col("o_custkey") % 10).alias("book"), (o % 41).alias("label"), (o % 200).alias("page"))
    return notes, merge.linked_notes(references, notes)


@query("note_links", NOTE_SQL + " SELECT reference, status, note_id FROM l")
def note_links(spark, sf_dir):
    """Note references with their notes: same page, later chapter notes, document notes; ambiguous ones stay open."""
    return _links(spark, sf_dir)[1]


@query("note_graph_links", NOTE_SQL + " SELECT n.note_id, n.scope, count(l.reference) AS refs FROM (SELECT DISTINCT note_id, scope FROM n) n LEFT JOIN l USING (note_id) GROUP BY n.note_id, n.scope")
def note_graph_links(spark, sf_dir):
    """The notes of the graph with the number of references that reach them."""
    notes, links = _links(spark, sf_dir)
    counts = links.where("note_id is not null").groupBy("note_id").agg(F.count("*").alias("refs"))
    return notes.select("note_id", "scope").distinct().join(counts, "note_id", "left").select("note_id", "scope", F.coalesce("refs", F.lit(0)).alias("refs"))


FRONT = ["cover", "half_title", "digitization_notice", "frontispiece", "title_page", "dedication", "preface", "contents", "list_of_illustrations", "map"]
FRONT_ROLES = ["blank", "cover", "cover", "blank", "title_page", "chapter_open", "preface", "preface", "map", "blank", "blank"]


@query("front_sections", BOOK + f""", r AS (SELECT source, page, {_dealt(FRONT_ROLES, 'page // 2')} AS role FROM book WHERE page <= 24), k AS (SELECT *, CASE WHEN role IN {_in(FRONT)} THEN role END AS own FROM r),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k), s AS (SELECT *, CASE WHEN (own IS NOT NULL AND own IS DISTINCT FROM before) OR page = 1 THEN 1 ELSE 0 END AS st FROM l),
i AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY page) AS island FROM s) SELECT source, coalesce(arg_min(own, page) FILTER (st = 1), 'unknown') AS section_type, min(page) AS start_page, max(page) AS end_page, count(*) AS page_count FROM i GROUP BY source, island""")
def front_sections(spark, sf_dir):
    """Front matter in sections: a new one where a role of front matter differs from the one before; all else extends it."""
    p = pages(spark, sf_dir).where("page <= 24").withColumn("role", dealt(FRONT_ROLES, F.floor(F.col("page") / 2)))
    rows = p.withColumn("own", F.when(F.col("role").isin(FRONT), F.col("role")))
    before = merge.last_before(rows, "source", "page", F.col("own"))
    rows = rows.withColumn("starts", (F.col("own").isNotNull() & ~F.col("own").eqNullSafe(before)) | (F.col("page") == 1))
    islands = book.islands(rows, "source", "page", F.col("starts"))
    kind = F.coalesce(F.max(F.when(F.col("starts"), F.col("own"))), F.lit("unknown"))
    return islands.groupBy("source", "island").agg(kind.alias("section_type"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("page_count")).drop("island")


CLASSES = ["body", "body", "front_matter", "index", "body", "toc", "appendix"]
SIDES = f"""WITH p AS (SELECT doc_id, source, text, {_dealt(CLASSES, 'doc_id')} AS cls, doc_id % 11 = 4 AS boundary FROM documents), every_side AS (SELECT doc_id, 'source' || chr(1) || source AS source, text, cls, boundary FROM p UNION ALL SELECT doc_id, 'target' || chr(1) || source, replace(text, 'a', 'ä'), cls, boundary FROM p WHERE doc_id % 5 > 0),
book AS (SELECT doc_id, source, text, boundary, CAST(doc_id AS INTEGER) AS page FROM every_side WHERE cls IN ('body', 'toc', 'index', 'appendix'))"""


@query("publication_clean_pass", "SELECT string_split(source, chr(1))[1] AS side, string_split(source, chr(1))[2] AS source, page AS doc_id, text_sha256, n_artifacts, n_numbers FROM (" + ORACLES["strip_running_artifacts"].replace(BOOK, SIDES).replace("AS l FROM book)", "AS l FROM book WHERE NOT boundary)", 1)
+ ") UNION ALL SELECT 'source', source, CAST(doc_id AS INTEGER), sha256(text), 0, 0 FROM documents WHERE doc_id % 7 = 2 UNION ALL SELECT 'target', source, CAST(doc_id AS INTEGER), sha256(replace(text, 'a', 'ä')), 0, 0 FROM documents WHERE doc_id % 7 = 2 AND doc_id % 5 > 0")
def publication_clean_pass(spark, sf_dir):
    """Running lines taken off both sides of page pairs by class of page."""
    n = F.col("doc_id")
    pairs = texts(spark, sf_dir).select("source", "doc_id", dealt(CLASSES, n).alias("page_class"), (n % 11 == 4).alias("chapter_boundary"), "text", F.when(n % 5 > 0, F.replace("text", F.lit("a"), F.lit("ä"))).alias("target"))
    out = book.clean_pairs(pairs)
    return out.select("side", "source", F.col("doc_id").cast("int").alias("doc_id"), keys.text_hash(F.col("text")).alias("text_sha256"), "n_artifacts", "n_numbers")
