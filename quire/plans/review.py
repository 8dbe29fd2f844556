"""Queries on reviews, alignment and terminal states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import alignment, folds, notes
from quire.functions import text as T
from quire.operators import book
from quire.plans.catalog import ARTIFACTS, BOOK, NEXT, RELATION, pages, query, table, texts


@query("term_masking", "SELECT page_id, sha256(html) AS restored, len(string_split(html, 'the')) > 1 AS has_term FROM pages")
def term_masking(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("and"), F.lit("href"))
    back = folds.unmasked(folds.masked(F.col("html"), terms), terms)
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(back.cast("binary"), 256).alias("restored"), F.contains("html", F.lit("the")).alias("has_term"))


@query("bridge_types", BOOK + """, r AS (SELECT source, page, CASE WHEN length(text) >= 400 THEN 'body' WHEN lang = 'de' THEN 'map' WHEN lang = 'fr' THEN 'illustration' WHEN length(text) < 100 THEN 'blank' ELSE 'text' END AS role FROM book),
e AS (SELECT source, page AS a, lead(page) OVER (PARTITION BY source ORDER BY page) AS b FROM r WHERE role = 'body'), j AS (SELECT e.source, e.a, e.b, list(r.role) FILTER (r.role IS NOT NULL) AS l FROM e LEFT JOIN r ON e.source = r.source AND r.page > e.a AND r.page < e.b WHERE e.b IS NOT NULL GROUP BY e.source, e.a, e.b)
SELECT source, a AS from_page, b AS to_page, CASE WHEN l IS NULL THEN 'adjacent' WHEN list_contains(l, 'map') THEN 'map' WHEN list_contains(l, 'illustration') AND list_contains(l, 'blank') THEN 'illustration_and_blank' WHEN list_contains(l, 'illustration') THEN 'illustration' WHEN list_contains(l, 'blank') THEN 'blank' ELSE 'other' END AS kind FROM j""")
def bridge_types(spark, sf_dir):
    n = F.col("n")
    role = F.when(n >= 400, "body").when(F.col("lang") == "de", "map").when(F.col("lang") == "fr", "illustration").when(n < 100, "blank").otherwise("text")
    rows = pages(spark, sf_dir, n=F.length("text")).select("source", "page", role.alias("role"))
    # pages between two body pages are an island behind the first
    rows = book.islands(rows, "source", "page", F.col("role") == "body").where("island > 0")
    runs = rows.groupBy("source", "island").agg(F.min("page").alias("from_page"), F.collect_list(F.when(F.col("role") != "body", F.col("role"))).alias("between"))
    w = Window.partitionBy("source").orderBy("from_page")
    return runs.withColumn("to_page", F.lead("from_page").over(w)).where("to_page is not null").select("source", "from_page", "to_page", notes.bridge_type(F.col("between")).alias("kind"))


@query("edge_flags", NEXT + f""", e AS (SELECT source, page, coalesce({RELATION.format('before', 'text')} = 'continue' AND before IS NOT NULL, false) AS incoming, coalesce(next_text IS NOT NULL AND {RELATION.format('text', 'next_text')} = 'continue', false) AS outgoing FROM n) SELECT * FROM e""")
def edge_flags(spark, sf_dir):
    joins = lambda a, b: F.coalesce(b.isNotNull() & a.isNotNull() & (T.marks_relation(a, b) == "continue"), F.lit(False))
    marked = book.marked(texts(spark, sf_dir))
    rows = book.beside(book.beside(marked, "marks", step=-1, name="before"), "marks", name="after")
    return rows.select("source", "page", joins(F.col("before.marks"), F.col("marks")).alias("incoming"), joins(F.col("marks"), F.col("after.marks")).alias("outgoing"))


@query("terminal_states", BOOK + """, s AS (SELECT b.source, b.page, CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'quarantined' WHEN length(trim(b.text)) = 0 THEN 'blank' ELSE 'missing' END AS state FROM book b LEFT JOIN labels l USING (doc_id))
SELECT source, state, count(*) AS pages, string_agg(page::VARCHAR, ',' ORDER BY page) AS list FROM s GROUP BY source, state""")
def terminal_states(spark, sf_dir):
    rows = pages(spark, sf_dir, blank=F.length(F.trim("text")) == 0).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "quarantined").when(F.col("blank"), "blank").otherwise("missing")
    return rows.groupBy("source", state.alias("state")).agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ",").alias("list"))


@query("alignment_audit", "WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, source, text FROM documents), b AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS n, lang FROM documents WHERE doc_id % 9 <> 0) SELECT source, count(*) FILTER (b.doc_id IS NULL) AS missing, count(*) FILTER (a.n <> b.n) AS moved, count(*) FILTER (b.doc_id IS NOT NULL AND length(a.text) >= 40 AND a.lang = b.lang) AS echoes FROM a LEFT JOIN b USING (doc_id) GROUP BY source")
def alignment_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("chars"))
    a = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    b = d.where("doc_id % 9 <> 0").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("chars", "doc_id")).alias("m"), F.col("lang").alias("l"))
    both = a.join(b, "doc_id", "left")
    return both.groupBy("source").agg(F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("n") != F.col("m")).alias("moved"), F.count_if(F.col("m").isNotNull() & (F.col("chars") >= 40) & (F.col("lang") == F.col("l"))).alias("echoes"))


#: As its expression here: letters beyond ASCII belong to words.
TERMS = "list_filter(list_distinct(regexp_extract_all(s, '\\b(?:[A-Z][A-Za-z0-9’''-]{2,}(?:\\s+[A-Z][A-Za-z0-9’''-]{2,}){0,3}|[A-Z]{2,12})\\b')), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.NO_TERMS) + "))"
STARTS = "list_transform(range(1, len(string_split({0}, {1}))), lambda i: list_sum(list_transform(string_split({0}, {1})[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length({1}))"


@query("glossary_occurrences", f"""WITH d AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g') AS s, text FROM documents), u AS (SELECT a.doc_id, a.s, a.text, b.text AS t FROM d a JOIN documents b ON b.doc_id = a.doc_id + 1),
w AS (SELECT doc_id, text, t, unnest({TERMS}) AS term FROM u), p AS (SELECT doc_id, text, term, {STARTS.format('text', 'term')} AS here, {STARTS.format('lower(t)', 'lower(term)')} AS there FROM w),
o AS (SELECT doc_id, text, term, there, unnest(range(1, len(here) + 1)) AS nth, unnest(here) AS h FROM p)
SELECT doc_id, term, nth::INTEGER AS nth, h::INTEGER AS source_start, there[nth]::INTEGER AS translated_start, sha256(regexp_replace(substr(text, greatest(h - 120, 0) + 1, least(h, 120)), '^\\s+|\\s+$', '', 'g')) AS before_sha256,
sha256(regexp_replace(substr(text, h + length(term) + 1, 120), '^\\s+|\\s+$', '', 'g')) AS after_sha256, CASE WHEN there[nth] IS NULL THEN 'needs_span_alignment' ELSE 'confirm_translation' END AS action FROM o""")
def glossary_occurrences(spark, sf_dir):
    """Each occurrence of a candidate term with the one of the same number in the next text, taken for its translation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t")), "doc_id")
    rows = both.select("doc_id", F.explode(alignment.term_occurrences(F.col("text"), F.col("t"))).alias("o"))
    h = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "o.term", "o.nth", "o.source_start", "o.translated_start", h("o.before").alias("before_sha256"), h("o.after").alias("after_sha256"), "o.action")


@query("clean_pass", ARTIFACTS + ", b AS (SELECT source, count(*) AS keys, sum(pages)::BIGINT AS hits FROM a GROUP BY source) SELECT k.source, count(*) AS pages, coalesce(any_value(b.keys), 0)::BIGINT AS keys, coalesce(any_value(b.hits), 0)::BIGINT AS hits FROM book k LEFT JOIN b ON k.source = b.source GROUP BY k.source")
def clean_pass(spark, sf_dir):
    p = texts(spark, sf_dir)
    found = book.running_artifacts(p).groupBy("source").agg(F.count("*").alias("keys"), F.sum("pages").alias("hits"))
    n = p.groupBy("source").agg(F.count("*").alias("pages"))
    return n.join(found, "source", "left").select("source", "pages", F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("hits", F.lit(0)).alias("hits"))


@query("valid_checkpoints", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT DISTINCT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 6 <> 0) c ON c.doc_id = d.doc_id AND c.h = sha256(d.text) WHERE l.quality = 1")
def valid_checkpoints(spark, sf_dir):
    """Truly cached: a checkpoint, a record, and the same fingerprint."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    records = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return d.join(records, "doc_id").join(d.where("doc_id % 6 <> 0").distinct(), ["doc_id", "h"]).select("doc_id")


@query("title_pick", "WITH t AS (SELECT source, doc_id, length(text) AS n, CASE WHEN length(text) <= 240 THEN 1 ELSE 2 END AS rank FROM documents) SELECT source, arg_min(doc_id, struct_pack(r := rank, d := doc_id)) AS title_doc, min(rank)::INTEGER AS rank FROM t GROUP BY source")
def title_pick(spark, sf_dir):
    rank = F.when(F.length("text") <= 240, 1).otherwise(2)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(rank, "doc_id")).alias("title_doc"), F.min(rank).alias("rank"))
