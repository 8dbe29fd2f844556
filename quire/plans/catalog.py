"""Queries over the driver's tables and, for each, SQL that gives the same rows.

A book is a ``source`` of ``documents`` and its pages are the rows in order of doc_id; sections are conversations, jobs are
orders, attempts are line items, and the event log is ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators import book, keys, merge, queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL side.
BOOK = "WITH book AS (SELECT doc_id, source, lang, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page FROM documents)"
BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
DONE = r"regexp_matches(regexp_replace(regexp_replace({0}, '\s+$', ''), '[\x22\x27”’)\]}}]+$', ''), '[.!?…]$')"
LOWER = "regexp_matches(regexp_extract({0}, '[A-Za-z]'), '^[a-z]$')"
RELATION = (
    "CASE WHEN {1} IS NULL THEN CASE WHEN " + DONE + " THEN 'no_join' ELSE 'unresolved' END WHEN " + DONE + " THEN 'no_join' WHEN " + LOWER.replace("{0}", "{1}")
    + r" OR regexp_matches({1}, '^\s*[,;:]') THEN 'continue' ELSE 'unresolved' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def wide(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer file splits than there are cores (a small one, by hash of doc_id) on all cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, sf_dir: str, **made: Column) -> DataFrame:
    """Numbered pages: doc_id, source, lang, page and columns made of the row, texts among them, before it is numbered."""
    docs = table(spark, sf_dir, "documents")
    if made:
        docs = wide(docs)
    return book.numbered_pages(docs.select("doc_id", "source", "lang", *(c.alias(name) for name, c in made.items())))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(table(spark, sf_dir, "documents"))


QUALITY = BOOK + rf"""
, m AS (SELECT source, page, text, {LINES} AS l, greatest(1, length(text)) AS total, length({BARE}) AS chars,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) AS n_alnum, len(regexp_extract_all(text, '\s')) AS n_space, length(text) - length(replace(text, chr(65533), '')) AS n_bad,
  list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda x: length(x))) AS longest,
  len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]-\s*\n\s*[A-Za-zÀ-ÖØ-öø-ÿ]')) AS hyphens FROM book),
q AS (SELECT *, round_even((len(l) - len(list_distinct(l))) / greatest(1, len(l)), 4) AS dup, round_even(n_alnum / total, 4) AS alnum, round_even(n_space / total, 4) AS space, round_even(n_bad / total, 4) AS bad FROM m),
s AS (SELECT *, 1.0 - CASE WHEN chars = 0 THEN 1.0 WHEN chars < 40 THEN 0.45 ELSE 0 END - CASE WHEN bad > 0.002 THEN 0.4 ELSE 0 END - CASE WHEN alnum < 0.25 AND chars >= 40 THEN 0.3 ELSE 0 END
  - CASE WHEN dup > 0.35 AND len(l) >= 6 THEN 0.25 ELSE 0 END - CASE WHEN longest > 180 THEN 0.25 ELSE 0 END AS raw FROM q),
r AS (SELECT *, raw >= 0.62 AND NOT (chars = 0 OR bad > 0.002 OR (alnum < 0.25 AND chars >= 40) OR longest > 180) AS passed FROM s)
"""


@query("page_text_quality", QUALITY + """SELECT source, page, CAST(chars AS INTEGER) AS text_characters, alnum AS alnum_ratio, space AS whitespace_ratio, dup AS duplicate_line_ratio,
  CAST(hyphens AS INTEGER) AS hyphenated_line_breaks, CAST(longest AS INTEGER) AS longest_unspaced_token, round(greatest(0, least(1, raw)), 4)::DOUBLE AS quality_score, passed,
  CASE WHEN passed THEN 'python_text' ELSE 'ocr_router' END AS recommended_route FROM r""")
def page_text_quality(spark, sf_dir):
    scored = pages(spark, sf_dir, q=T.page_quality(F.col("text")))
    return scored.select("source", "page", *(f"q.{c}" for c in ("text_characters", "alnum_ratio", "whitespace_ratio", "duplicate_line_ratio", "hyphenated_line_breaks", "longest_unspaced_token", "quality_score", "passed", "recommended_route")))


@query("page_intake_summary", QUALITY + """SELECT source, count(*) AS pages, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS review,
  coalesce(string_agg(CASE WHEN NOT passed THEN page::VARCHAR END, ',' ORDER BY page), '') AS review_pages, min(chars)::INTEGER AS min_chars, max(chars)::INTEGER AS max_chars, sum(chars)::BIGINT AS chars, round_even(avg(chars), 2) AS mean_chars
  FROM r GROUP BY source""")
def page_intake_summary(spark, sf_dir):
    return book.intake_summary(pages(spark, sf_dir, q=T.page_quality(F.col("text"))).select("source", "page", "q.passed", "q.text_characters"))


def _marks(marks: list[str]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{m.replace(chr(39), chr(39) * 2)}', ''))) // {len(m)}" for m in marks)


@query("detect_language", "WITH d AS (SELECT doc_id, lang, ' ' || lower(substr(text, 1, 50000)) || ' ' AS t FROM documents), c AS (SELECT doc_id, lang, " + ", ".join(f"{_marks(m)} AS n_{k}" for k, m in T.LANGUAGE_MARKS.items()) + """ FROM d)
SELECT doc_id, lang, CASE WHEN greatest(n_fr, n_de, n_es, n_en) = 0 THEN 'en' WHEN n_fr = greatest(n_fr, n_de, n_es, n_en) THEN 'fr' WHEN n_de = greatest(n_fr, n_de, n_es, n_en) THEN 'de' WHEN n_es = greatest(n_fr, n_de, n_es, n_en) THEN 'es' ELSE 'en' END AS detected FROM c""")
def detect_language(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", "lang", T.detect_language(F.col("text")).alias("detected"))


ARTIFACTS = BOOK + rf"""
, l AS (SELECT source, page, {LINES} AS l FROM book),
e AS (SELECT source, page, unnest(l[1:3] || l[greatest(len(l) - 2, 1):]) AS line FROM l),
k AS (SELECT source, page, line, regexp_replace(replace(lower(regexp_replace(line, '\s+', ' ', 'g')), 'ß', 'ss'), '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g') AS key FROM e),
w AS (SELECT *, len(list_filter(string_split(key, ' '), lambda x: x <> '')) AS words FROM k),
f AS (SELECT source, key, words, count(DISTINCT page) AS pages FROM w WHERE key <> '' AND length(line) <= 60 AND words <= 8
  AND NOT regexp_matches(line, '(?i)^(chapter|chapitre|kapitel|cap[ií]tulo|appendix|annexe)\s+([IVXLCDM]+|\d+)([^\w]|$)') AND (words <> 1 OR length(replace(key, ' ', '')) >= 6)
  AND NOT regexp_matches(key, '(?i)^(\d{{1,4}}|[ivxlcdm]{{1,6}})$') GROUP BY ALL),
a AS (SELECT source, key, pages FROM f WHERE pages >= CASE WHEN length(key) >= 12 OR words >= 3 THEN 2 ELSE 3 END)
"""


@query("running_artifacts", ARTIFACTS + "SELECT * FROM a")
def running_artifacts(spark, sf_dir):
    return book.running_artifacts(texts(spark, sf_dir))


@query("strip_running_artifacts", ARTIFACTS + rf""", n1 AS (SELECT source, page, string_split(text, chr(10)) AS rows FROM book), u1 AS (SELECT source, page, generate_subscripts(rows, 1) AS i, unnest(rows) AS line FROM n1),
f1 AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY i) AS up, row_number() OVER (PARTITION BY source, page ORDER BY i DESC) AS down FROM u1 WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
g1 AS (SELECT source, page, i, line, regexp_replace(replace(lower(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^ | $', '', 'g')), 'ß', 'ss'), '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g') AS key FROM f1 WHERE up <= 3 OR down <= 3),
h1 AS (SELECT g1.*, a.key IS NOT NULL AS art FROM g1 LEFT JOIN a USING (source, key)), o1 AS (SELECT source, page, i FROM h1 WHERE art),
z1 AS (SELECT h1.source, h1.page, h1.i FROM h1 WHERE NOT art AND regexp_matches(line, '(?i)^\s*(?:\d{{1,4}}|[ivxlcdm]{{1,6}})[.!]?\s*$') AND EXISTS (SELECT 1 FROM o1 WHERE o1.source = h1.source AND o1.page = h1.page AND abs(o1.i - h1.i) <= 2)),
y1 AS (SELECT h1.source, h1.page, count(*) FILTER (regexp_matches(line, '(?i)^\s*(?:\d{{1,4}}|[ivxlcdm]{{1,6}})[.!]?\s*$') AND EXISTS (SELECT 1 FROM o1 WHERE o1.source = h1.source AND o1.page = h1.page AND abs(o1.i - h1.i) <= 2)) AS n FROM h1 GROUP BY h1.source, h1.page),
k2 AS (SELECT u1.source, u1.page, u1.i, u1.line FROM u1 ANTI JOIN o1 USING (source, page, i) ANTI JOIN z1 USING (source, page, i)), t2 AS (SELECT source, page, string_agg(line, chr(10) ORDER BY i) AS t FROM k2 GROUP BY source, page), c2 AS (SELECT source, page, count(*) AS n FROM o1 GROUP BY source, page)
SELECT n1.source, n1.page, sha256(coalesce(t2.t, '')) AS text_sha256, CAST(coalesce(c2.n, 0) AS INTEGER) AS n_artifacts, CAST(coalesce(y1.n, 0) AS INTEGER) AS n_numbers FROM n1 LEFT JOIN t2 USING (source, page) LEFT JOIN c2 USING (source, page) LEFT JOIN y1 USING (source, page)""")
def strip_running_artifacts(spark, sf_dir):
    docs = texts(spark, sf_dir)
    out = book.strip_running_artifacts(docs, book.running_artifacts(docs))
    slim = out.select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_artifacts", "n_numbers")
    return book.numbered_pages(slim).drop("doc_id")


NEXT = BOOK + ", n AS (SELECT source, page, text, lead(page) OVER w AS next_page, lead(text) OVER w AS next_text, lag(text) OVER w AS before FROM book WINDOW w AS (PARTITION BY source ORDER BY page))"


@query("page_edges", NEXT + rf""", e AS (SELECT *, regexp_replace(text, '\s+$', '') AS a, regexp_replace(next_text, '^\s+', '') AS b FROM n)
SELECT source, page, next_page, {RELATION.format('text', 'next_text')} AS relation, coalesce(CASE WHEN a = '' OR b = '' THEN false WHEN regexp_matches(a, '[-‐‑‒–]$') THEN true
  WHEN regexp_matches(a, '[.!?。！？；;：:]$') THEN false WHEN regexp_matches(b, '^[\p{{Ll}}\p{{Nd}}]') THEN true ELSE regexp_matches(a, '[,，、(\p{{L}}\p{{N}}]$') END, false) AS continues FROM e""")
def page_edges(spark, sf_dir):
    return book.page_edges(texts(spark, sf_dir))


@query("logical_blocks", NEXT + rf""", s AS (SELECT source, page, {BARE} AS bare, CASE WHEN before IS NOT NULL AND {RELATION.format('before', 'text')} = 'continue' THEN 0 ELSE 1 END AS st FROM n),
i AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY page) AS island FROM s),
g AS (SELECT source, min(page) AS first_page, max(page) AS last_page, count(*) AS fragments, string_agg(bare, ' ' ORDER BY page) AS t FROM i GROUP BY source, island)
SELECT source, first_page, last_page, fragments, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS text_sha256 FROM g""")
def logical_blocks(spark, sf_dir):
    return book.logical_blocks(texts(spark, sf_dir))


@query("block_contexts", """SELECT conv_id, turn, role, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_turn,
  first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_answer FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def block_contexts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    return rows.select(
        "conv_id", "turn", "role", F.lag("turn").over(w).alias("previous_turn"), F.lead("turn").over(w).alias("next_turn"),
        merge.last_before(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"),
        F.first(F.when(F.col("role") == "assistant", F.col("turn")), True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_answer"),
    )


@query("carry_batches", BOOK + """, n AS (SELECT source, max(page) AS n FROM book GROUP BY source), b AS (SELECT source, n, unnest(generate_series(0, n // 9)) AS batch FROM n)
SELECT k.source, CAST(b.batch AS INTEGER) AS batch, k.page, b.batch > 0 AND k.page <= b.batch * 9 + 1 AS carried FROM book k JOIN b ON k.source = b.source AND k.page BETWEEN b.batch * 9 + 1 AND b.batch * 9 + 10 AND (b.batch = 0 OR b.batch * 9 + 1 < b.n)""")
def carry_batches(spark, sf_dir):
    return book.carry_batches(pages(spark, sf_dir))


@query("page_batches", BOOK + " SELECT source, CAST((page - 1) // 20 AS BIGINT) AS batch, count(*) AS pages, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM book GROUP BY ALL")
def page_batches(spark, sf_dir):
    return pages(spark, sf_dir).groupBy("source", F.floor((F.col("page") - 1) / 20).alias("batch")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# pages of even length are taken as missing to give the audit something to find
@query("source_coverage_audit", BOOK + """, h AS (SELECT source, page FROM book WHERE length(text) % 7 <> 0), x AS (SELECT source, max(page) AS last FROM book GROUP BY source),
w AS (SELECT source, unnest(generate_series(1, last)) AS page FROM x), c AS (SELECT source, page, count(*) AS n, page - lag(page) OVER (PARTITION BY source ORDER BY page) > 1 AS gap FROM h GROUP BY source, page)
SELECT w.source, count(*) FILTER (c.n IS NULL) AS missing, count(*) FILTER (c.n > 1) AS duplicate, count(*) FILTER (c.gap) AS gaps FROM w LEFT JOIN c USING (source, page) GROUP BY w.source""")
def source_coverage_audit(spark, sf_dir):
    p = pages(spark, sf_dir, n=F.length("text"))
    return book.coverage_audit(p.where("n % 7 <> 0"), p.groupBy("source").agg(F.lit(1).alias("first"), F.max("page").alias("last")))


@query("bridge_candidates", BOOK + ", b AS (SELECT source, page AS from_page, lead(page) OVER (PARTITION BY source ORDER BY page) AS to_page FROM book WHERE length(text) >= 400) SELECT source, from_page, to_page, to_page - from_page - 1 AS between, to_page - from_page > 10 AS too_far FROM b WHERE to_page - from_page > 1")
def bridge_candidates(spark, sf_dir):
    return book.bridges(pages(spark, sf_dir, n=F.length("text")), F.col("n") >= 400)


@query("printed_page_counter", BOOK + " SELECT source, page, CASE WHEN length(text) >= 400 THEN sum(CASE WHEN length(text) >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page) END::BIGINT AS printed FROM book")
def printed_page_counter(spark, sf_dir):
    return book.printed_pages(pages(spark, sf_dir, n=F.length("text")), F.col("n") >= 400)


@query("class_segments", BOOK + """, c AS (SELECT source, page, lang, CASE WHEN lag(lang) OVER (PARTITION BY source ORDER BY page) IS NOT DISTINCT FROM lang THEN 0 ELSE 1 END AS st FROM book),
i AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY page) AS island FROM c) SELECT source, lang, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM i GROUP BY source, island, lang""")
def class_segments(spark, sf_dir):
    p = pages(spark, sf_dir)
    starts = ~F.col("lang").eqNullSafe(F.lag("lang").over(Window.partitionBy("source").orderBy("page")))
    rows = book.islands(p.withColumn("starts", starts), "source", "page", F.col("starts"))
    return rows.groupBy("source", "island", "lang").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages")).drop("island")


SECTIONS = BOOK + ", sec AS (SELECT source, (page - 1) // 7 AS section, min(page) AS first, max(page) AS last FROM book GROUP BY ALL)"


def sections(p: DataFrame) -> DataFrame:
    return p.groupBy("source", F.floor((F.col("page") - 1) / 7).alias("section")).agg(F.min("page").alias("first"), F.max("page").alias("last"))


@query("section_membership", SECTIONS + " SELECT b.doc_id, b.source, b.page, CAST(s.section AS BIGINT) AS section FROM book b JOIN sec s ON b.source = s.source AND b.page BETWEEN s.first AND s.last")
def section_membership(spark, sf_dir):
    p = pages(spark, sf_dir)
    return merge.in_interval(p, sections(p), "source", "page", "first", "last").select("doc_id", "source", "page", "section")


@query("section_mapping_quarantine", SECTIONS + """, u AS (SELECT doc_id AS unit, source, unnest([page, page + 1]) AS page FROM book), f AS (SELECT u.unit, list_sort(list(DISTINCT s.section) FILTER (s.section IS NOT NULL)) AS l FROM u
LEFT JOIN sec s ON u.source = s.source AND u.page BETWEEN s.first AND s.last AND s.section % 3 <> 2 GROUP BY u.unit) SELECT unit, CASE WHEN coalesce(len(l), 0) = 0 THEN 'no_section_found' WHEN len(l) > 1 THEN 'crosses_section_boundary' ELSE 'mapped' END AS status, CASE WHEN len(l) = 1 THEN CAST(l[1] AS BIGINT) END AS section FROM f""")
def section_mapping_quarantine(spark, sf_dir):
    p = pages(spark, sf_dir)
    units = p.select(F.col("doc_id").alias("unit"), "source", F.array("page", F.col("page") + 1).alias("pages"))
    known = merge.in_interval(p, sections(p).where("section % 3 <> 2"), "source", "page", "first", "last").select("source", "page", "section")
    return merge.quarantine(units, known)


@query("unit_keys", BOOK + " SELECT doc_id, 'tu_' || substr(sha256(concat_ws('|', source, page, sha256(text))), 1, 24) AS unit_id, sha256(text) AS text_sha256, sha256('{\"page\":' || page || ',\"source\":\"' || source || '\"}') AS stable_hash FROM book")
def unit_keys(spark, sf_dir):
    digest = F.col("digest")
    stable = keys.canonical_json(page=F.col("page"), source=F.col("source"))
    return pages(spark, sf_dir, digest=keys.text_hash(F.col("text"))).select("doc_id", keys.unit_id(F.col("source"), F.col("page").cast("string"), digest).alias("unit_id"), digest.alias("text_sha256"), keys.text_hash(stable).alias("stable_hash"))


@query("pending_units", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_units(spark, sf_dir):
    return keys.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("content_reuse", r"SELECT doc_id FROM documents WHERE " + BARE + r" IN (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') FROM documents GROUP BY 1 HAVING count(*) > 1)")
def content_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    twice = d.groupBy(T.strip(F.col("text")).alias("text")).agg(F.count("*").alias("n")).where("n > 1")
    return keys.reusable(d, twice).select("doc_id")


@query("translation_reuse", "SELECT d.doc_id, m.first AS reuse_of, CASE WHEN m.first IS NULL THEN 'pending' ELSE 'reused' END AS state FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS first FROM documents WHERE doc_id % 2 = 0 GROUP BY text) m ON d.text = m.text WHERE d.doc_id % 2 = 1")
def translation_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return keys.first_match(d.where("doc_id % 2 = 1").select("doc_id", "text"), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "text"), "id").select("doc_id", "reuse_of", "state")


@query("precedence_merge", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'manual' WHEN d.n_chars < 500 THEN 'middle' ELSE 'base' END AS evidence, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'rejected' WHEN d.n_chars < 500 THEN 'short' ELSE d.lang END AS role FROM documents d LEFT JOIN labels l USING (doc_id)")
def precedence_merge(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = d.select("doc_id", F.col("lang").alias("role"))
    return merge.precedence(base, d.where("n_chars < 500").select("doc_id", F.lit("short").alias("role")), labels.where("quality = 0").select("doc_id", F.lit("rejected").alias("role")), "doc_id", ["role"])


@query("job_queue_poll", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 10")
def job_queue_poll(spark, sf_dir):
    return queue.poll(table(spark, sf_dir, "orders").withColumn("state", F.col("o_orderstatus")), "O", "o_orderdate", "o_orderkey", 10).select("o_orderkey", "o_custkey", "o_orderdate")


STATE_SQL = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'paused' ELSE 'completed' END"


def jobs(spark, sf_dir) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "paused").otherwise("completed")
    return table(spark, sf_dir, "orders").withColumn("state", state)


@query("batch_state_rollup", f"""WITH j AS (SELECT o_custkey, {STATE_SQL} AS state FROM orders) SELECT o_custkey, count(*) AS jobs, count(*) FILTER (state = 'paused') AS paused, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled,
CASE WHEN count(*) FILTER (state = 'paused') > 0 THEN 'paused' WHEN count(*) FILTER (state = 'queued') > 0 THEN 'queued' ELSE 'completed' END AS batch_state FROM j GROUP BY o_custkey""")
def batch_state_rollup(spark, sf_dir):
    return queue.batch_state(jobs(spark, sf_dir), "o_custkey")


@query("usage_summary", "SELECT l_suppkey, count(*) AS attempts, sum(l_quantity)::DOUBLE AS tokens, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, count(*) FILTER (l_returnflag = 'R') AS retried, max(l_shipdate) AS last_attempt FROM lineitem GROUP BY l_suppkey")
def usage_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("attempts"), F.sum("l_quantity").alias("tokens"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"),
        F.count_if(F.col("l_returnflag") == "R").alias("retried"), F.max("l_shipdate").alias("last_attempt"),
    )


@query("latest_job_per_source", f"SELECT c_custkey, c_name, o_orderkey, CASE WHEN o_orderkey IS NOT NULL THEN {STATE_SQL} END AS state FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1")
def latest_job_per_source(spark, sf_dir):
    last = queue.latest(jobs(spark, sf_dir), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, sf_dir, "customer")
    return c.join(last, c["c_custkey"] == last["o_custkey"], "left").select("c_custkey", "c_name", "o_orderkey", "state")


@query("job_listing", f"SELECT o_orderkey, c_name, coalesce(n_name, 'unknown') AS project, r_name AS scope, {STATE_SQL} AS state FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def job_listing(spark, sf_dir):
    o, c, n, r = jobs(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return rows.select("o_orderkey", "c_name", F.coalesce("n_name", F.lit("unknown")).alias("project"), F.col("r_name").alias("scope"), "state")


@query("distinct_providers", "SELECT DISTINCT l_suppkey, l_linestatus FROM lineitem")
def distinct_providers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linestatus").distinct()


@query("queue_snapshot", f"WITH j AS (SELECT {STATE_SQL} AS state, o_orderkey FROM orders) SELECT count(*) AS jobs, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'paused') AS paused, count(*) FILTER (state = 'completed') AS completed, round(count(*) FILTER (state = 'completed') / count(*), 6) AS progress, max(o_orderkey) AS last_job FROM j")
def queue_snapshot(spark, sf_dir):
    n = lambda s: F.count_if(F.col("state") == s)
    return jobs(spark, sf_dir).agg(F.count("*").alias("jobs"), n("queued").alias("queued"), n("paused").alias("paused"), n("completed").alias("completed"), F.round(n("completed") / F.count("*"), 6).alias("progress"), F.max("o_orderkey").alias("last_job"))


@query("plan_report", "SELECT lang, count(*) AS units, sum(length(text))::BIGINT AS chars, sum(length(text) // 4 + 1)::BIGINT AS token_estimate FROM documents GROUP BY lang")
def plan_report(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("units"), F.sum(n).alias("chars"), F.sum(F.floor(n / 4) + 1).alias("token_estimate"))


@query("event_cursor", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def event_cursor(spark, sf_dir):
    return queue.after_cursor(table(spark, sf_dir, "events"), "event_id", 100, 500).select("event_id", "user_id", "event_type")


@query("event_fanout", "SELECT event_id, user_id, event_type, 0 AS step FROM events UNION ALL SELECT event_id, user_id, 'snapshot.updated', 1 FROM events WHERE event_type <> 'snapshot.updated'")
def event_fanout(spark, sf_dir):
    return queue.fan_out(table(spark, sf_dir, "events"))


@query("job_last_state", "SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS last_event, count(*) AS events, count(*) + 1 AS next_attempt FROM events GROUP BY user_id")
def job_last_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("last_event"), F.count("*").alias("events"), (F.count("*") + 1).alias("next_attempt"))


@query("failure_streaks", """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS st FROM events), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY user_id, run, event_type HAVING count(*) >= 3""")
def failure_streaks(spark, sf_dir):
    return queue.streaks(table(spark, sf_dir, "events"), "user_id", "event_id", 3)


#: Decisions on the rows of e (stream, arrival, event_id, sequence, matches), one arrival after another.
ACCEPTANCE = """, r AS (SELECT stream, arrival, event_id, sequence, CASE WHEN NOT matches THEN 'schema_mismatch' WHEN sequence <= 0 THEN 'out_of_order' ELSE 'accepted' END AS decision, CASE WHEN matches AND sequence > 0 THEN sequence ELSE 0 END AS cursor, CASE WHEN matches AND sequence > 0 THEN [event_id] ELSE []::BIGINT[] END AS seen FROM e WHERE arrival = 1
UNION ALL SELECT s.stream, s.arrival, s.event_id, s.sequence, s.d, CASE WHEN s.d = 'accepted' THEN s.sequence ELSE s.cursor END, CASE WHEN s.d = 'accepted' THEN list_append(s.seen, s.event_id) ELSE s.seen END FROM
(SELECT e.stream, e.arrival, e.event_id, e.sequence, r.cursor, r.seen, CASE WHEN NOT e.matches THEN 'schema_mismatch' WHEN list_contains(r.seen, e.event_id) THEN 'duplicate' WHEN e.sequence <= r.cursor THEN 'out_of_order' WHEN r.cursor > 0 AND e.sequence > r.cursor + 1 THEN 'sequence_gap' ELSE 'accepted' END AS d FROM r JOIN e ON e.stream = r.stream AND e.arrival = r.arrival + 1) s)"""


@query("event_acceptance", """WITH RECURSIVE e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS arrival, event_id // 3 AS event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 11 = 0 THEN -2 ELSE 0 END AS BIGINT) AS sequence, event_id % 17 <> 5 AS matches FROM events)"""
+ ACCEPTANCE + " SELECT stream, arrival, event_id, sequence, decision FROM r")
def event_acceptance(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(w).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), n.alias("arrival"), F.floor(F.col("event_id") / 3).alias("event_id"), (n + F.when(F.col("event_id") % 11 == 0, -2).otherwise(0)).alias("sequence"), (F.col("event_id") % 17 != 5).alias("matches"))
    return queue.accepted(rows)


@query("call_budget", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 100 AS granted FROM events")
def call_budget(spark, sf_dir):
    return queue.within_budget(table(spark, sf_dir, "events"), "event_type", "event_id", 100).select("event_id", "event_type", "granted")


@query("event_usage_json", "SELECT event_type, count(*) AS events, sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0))::BIGINT AS total_k, round(sum(coalesce(value, 0)), 4) AS total_value FROM events GROUP BY event_type")
def event_usage_json(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("total_k"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total_value"))


@query("priority_topk", NEXT + f", e AS (SELECT source, page, {RELATION.format('text', 'next_text')} AS relation FROM n) SELECT source, page, relation, CAST(CASE relation WHEN 'unresolved' THEN 0 WHEN 'continue' THEN 1 ELSE 2 END AS INTEGER) AS priority FROM e ORDER BY priority, source, page LIMIT 50")
def priority_topk(spark, sf_dir):
    rank = F.when(F.col("relation") == "unresolved", 0).when(F.col("relation") == "continue", 1).otherwise(2)
    return book.page_edges(texts(spark, sf_dir)).select("source", "page", "relation", rank.alias("priority")).orderBy("priority", "source", "page").limit(50)


def _times(marks: list[str], c: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in marks)


@query("representative_picks", BOOK + f""", s AS (SELECT source, page, doc_id, length(text) AS chars, {_times(T.OLD_MARKERS, 'lower(text)')} AS old, len(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g'), '\\b[A-Z][a-z]+(?:-[A-Z][a-z]+)?\\b')) AS names,
  length(text) + 120 * (4 * length(text) - length(replace(text, '!', '')) - length(replace(text, ';', '')) - length(replace(text, ':', '')) - length(replace(text, '—', ''))) AS rhetoric FROM book), b AS (SELECT * FROM s WHERE chars > 300),
k1 AS (SELECT source, 'structural_title' AS kind, arg_max(page, (doc_id % 2, chars, page)) AS page FROM s WHERE chars <= 300 GROUP BY source),
k2 AS (SELECT source, 'proper_names_or_historical_voice' AS kind, arg_max(page, (old, names, chars, page)) AS page FROM b GROUP BY source), t2 AS (FROM b ANTI JOIN k2 USING (source, page)),
k3 AS (SELECT source, 'rhetorical_long_form' AS kind, arg_max(page, (rhetoric, page)) AS page FROM t2 GROUP BY source), t3 AS (FROM t2 ANTI JOIN k3 USING (source, page)),
k4 AS (SELECT source, 'cross_page' AS kind, arg_max(page, (-chars, page)) AS page FROM t3 WHERE doc_id % 3 = 0 GROUP BY source), k5 AS (SELECT source, 'ordinary_single_page' AS kind, arg_max(page, (-abs(chars - 450), page)) AS page FROM t3 WHERE doc_id % 3 > 0 AND chars BETWEEN 250 AND 800 GROUP BY source)
FROM k1 UNION ALL FROM k2 UNION ALL FROM k3 UNION ALL FROM k4 UNION ALL FROM k5""")
def representative_picks(spark, sf_dir):
    """A title and four bodies of each book, none of them twice; short pages stand for titles, every third page for one that runs on."""
    t, n, chars = F.col("text"), F.col("doc_id"), F.col("chars")
    scores = {"chars": F.length(t), "old": T.old_voice(t), "names": T.proper_names(t), "rhetoric": T.rhetoric(t)}
    body, runs_on = chars > 300, n % 3 == 0
    kinds = {
        "structural_title": (chars <= 300, F.array((n % 2).cast("int"), chars)), "proper_names_or_historical_voice": (body, F.array("old", "names", "chars")), "rhetorical_long_form": (body, F.array("rhetoric")),
        "cross_page": (body & runs_on, F.array(-chars)), "ordinary_single_page": (body & ~runs_on & chars.between(250, 800), F.array(-F.abs(chars - 450))),
    }
    return queue.picked(pages(spark, sf_dir, **scores), "source", "page", kinds)


#: Letters beyond ASCII are letters to the rule, which SQL's word edges don't know: they stand as underlines there.
ONLY_IN = "list_sort(list_distinct(list_filter(regexp_extract_all({0}, '{2}'), lambda x: NOT list_contains(regexp_extract_all({1}, '{2}'), x))))"
FIGURES, CAPITALS = r"\b\d+(?:[.,]\d+)*\b", r"\b[A-Z][A-Za-z''-]{2,}\b"


@query("token_differences", "WITH t AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g') AS t FROM documents) SELECT a.doc_id, " + ", ".join(
    f"array_to_string({ONLY_IN.format(x, y, p) + ('[1:30]' if p is CAPITALS else '')}, ' ') AS {name}"
    for name, x, y, p in (("numbers_here", "a.t", "b.t", FIGURES), ("numbers_next", "b.t", "a.t", FIGURES), ("capitalised_here", "a.t", "b.t", CAPITALS), ("capitalised_next", "b.t", "a.t", CAPITALS))
) + " FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def token_differences(spark, sf_dir):
    """Numbers and, up to 30, capitalised words that only one of two neighbouring texts has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    here, other = F.col("text"), F.col("other")
    joined = lambda c, name: F.array_join(c, " ").alias(name)
    return both.select(
        "doc_id", joined(T.numbers_only_in(here, other), "numbers_here"), joined(T.numbers_only_in(other, here), "numbers_next"),
        joined(T.capitalised_only_in(here, other), "capitalised_here"), joined(T.capitalised_only_in(other, here), "capitalised_next"),
    )


@query("glossary_counts", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+-[A-Z][a-z]+|[A-Z][a-zäöüßéèñ]{5,}')) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY term HAVING count(DISTINCT doc_id) >= 2")
def glossary_counts(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+-[A-Z][a-z]+|[A-Z][a-zäöüßéèñ]{5,}"), F.lit(0))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("docs >= 2")


@query("protected_literals", r"""SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?i)(?:https?://|www\.)[^\s<>{}\[\]"'']+|\b10\.\d{4,9}/[-._;()/:a-z0-9]+\b|\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b'), lambda x: regexp_replace(x, '[.,;:!?)\]}]+$', '')), lambda x: x <> ''))), ' '), '') AS literals FROM pages""")
def protected_literals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.array_join(F.array_sort(T.protected_literals(F.col("html"))), " "), F.lit("")).alias("literals"))


@query("text_normalisers", r"""SELECT doc_id, sha256(regexp_replace(lower(replace(text, 'æ', 'ae')), '[^a-z0-9]+', '', 'g')) AS title_key, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*#{1,6}\s+', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS visible, sha256(regexp_replace(text, '\s+', '', 'g')) AS rendered,
(length(text) + 120 * (4 * length(text) - length(replace(text, '!', '')) - length(replace(text, ';', '')) - length(replace(text, ':', '')) - length(replace(text, '—', ''))))::INTEGER AS rhetoric FROM documents""")
def text_normalisers(spark, sf_dir):
    t, h = F.col("text"), lambda c: keys.text_hash(c)
    return table(spark, sf_dir, "documents").select("doc_id", h(T.title_key(t)).alias("title_key"), h(T.visible_text(t)).alias("visible"), h(T.rendered_text(t)).alias("rendered"), T.rhetoric(t).alias("rhetoric"))


@query("secret_redaction", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)bearer\s+\S+', 'Bearer [REDACTED]', 'g'), '(?i)(api[_-]?key|authorization|bearer|secret|token)(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'g')) AS redacted FROM documents")
def secret_redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.text_hash(T.redacted(F.col("text"))).alias("redacted"))


@query("safe_filenames", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\x00-\x1f<>:"/\\|?*]+', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS c FROM pages), b AS (SELECT page_id, CASE WHEN c = '' THEN 'Book' ELSE c END AS c FROM a)
SELECT page_id, regexp_replace(substr(c, 1, 120), '[ .]+$', '') AS filename FROM b""")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


@query("chunks", rf"""WITH l AS (SELECT doc_id, flatten(list_transform({LINES}, lambda x: list_transform(range(0, (length(x) - 1) // 3500 + 1), lambda i: substr(x, CAST(i * 3500 + 1 AS BIGINT), 3500)))) AS p FROM documents),
e AS (SELECT doc_id, list_transform(p, lambda x: {{'d': []::VARCHAR[], 'w': regexp_replace(x, '^\s+|\s+$', '', 'g'), 'p': x}}) AS e FROM l WHERE len(p) > 0),
r AS (SELECT doc_id, list_reduce(e, lambda a, x: CASE WHEN a.w <> '' AND length(a.w) + length(x.p) + 1 > 3500 THEN {{'d': list_append(a.d, a.w), 'w': x.w, 'p': x.p}} ELSE {{'d': a.d, 'w': regexp_replace(CASE WHEN a.w = '' THEN x.p ELSE a.w || chr(10) || x.p END, '^\s+|\s+$', '', 'g'), 'p': x.p}} END) AS r FROM e),
c AS (SELECT doc_id, CASE WHEN r.w = '' THEN r.d ELSE list_append(r.d, r.w) END AS c FROM r), u AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS t FROM c)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS text_sha256 FROM u""")
def chunked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("chars"), keys.text_hash(F.col("text")).alias("text_sha256"))


@query("reflow_text")
def reflow_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.text_hash(T.reflowed(F.col("text"))).alias("text_sha256"))


@query("numerals", "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN substr('零一二三四五六七八九', n_nationkey + 1, 1) ELSE CASE WHEN n_nationkey < 20 THEN '' ELSE substr('零一二三四五六七八九', n_nationkey // 10 + 1, 1) END || '十' || CASE WHEN n_nationkey % 10 = 0 THEN '' ELSE substr('零一二三四五六七八九', n_nationkey % 10 + 1, 1) END END AS chinese FROM nation")
def numerals(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.chinese_number(F.col("n_nationkey")).alias("chinese"))


@query("patch_validation", "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_item' WHEN l.doc_id % 5 = 0 THEN 'source_changed' WHEN l.quality = 0 AND l.toxic = 0 THEN 'no_change' ELSE 'accepted' END AS decision FROM labels l LEFT JOIN documents d USING (doc_id)")
def patch_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", keys.text_hash(F.col("text")).alias("current"))
    patches = table(spark, sf_dir, "labels").join(d, "doc_id", "left").withColumn("base", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("current")))
    code = F.when(F.col("current").isNull(), "unknown_item").when(F.col("base") != F.col("current"), "source_changed").when((F.col("quality") == 0) & (F.col("toxic") == 0), "no_change").otherwise("accepted")
    return patches.select("doc_id", code.alias("decision"))


@query("field_diff", "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE toxic END AS toxic FROM labels) SELECT doc_id, 'changed' AS kind, 'quality' AS field, l.quality::VARCHAR AS old_value, n.quality::VARCHAR AS new_value FROM labels l JOIN n USING (doc_id) WHERE l.quality IS DISTINCT FROM n.quality UNION ALL SELECT doc_id, 'changed', 'toxic', l.toxic::VARCHAR, n.toxic::VARCHAR FROM labels l JOIN n USING (doc_id) WHERE l.toxic IS DISTINCT FROM n.toxic")
def field_diff(spark, sf_dir):
    old = table(spark, sf_dir, "labels")
    new = old.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 4 != 0, F.col("toxic")).alias("toxic"))
    return merge.differing(old, new, "doc_id", ["quality", "toxic"])


@query("commit_reconciliation", "WITH c AS (SELECT doc_id, quality = 1 AS valid FROM labels), s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'pending' ELSE 'failed' END AS status FROM documents), r AS (SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, s.status AS old, CASE WHEN c.valid THEN 'validated' WHEN s.status = 'validated' THEN 'failed_retryable' ELSE coalesce(s.status, 'unknown_unit') END AS status FROM c FULL JOIN s ON c.doc_id = s.doc_id) SELECT doc_id, status, coalesce(old, '') <> status AS changed FROM r")
def commit_reconciliation(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    state = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "validated").when(F.col("doc_id") % 3 == 1, "pending").otherwise("failed").alias("status"))
    return merge.reconciled(cache, state, "doc_id")


@query("immutability_audit", "SELECT l_partkey AS key, count(DISTINCT l_returnflag) AS values, count(*) AS rows FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def immutability_audit(spark, sf_dir):
    return keys.conflicting(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_returnflag"))


@query("command_idempotency", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def command_idempotency(spark, sf_dir):
    return keys.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("append_only_units", "SELECT doc_id, 'held' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_only_units(spark, sf_dir):
    held = table(spark, sf_dir, "labels").select("doc_id", F.lit("held").alias("origin"))
    return keys.append_unseen(held, table(spark, sf_dir, "documents").select("doc_id", F.lit("new").alias("origin")), "doc_id")


@query("set_difference", "SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def set_difference(spark, sf_dir):
    want = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).distinct()
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return want.join(have, "key", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(want, "key", "left_anti").withColumn("side", F.lit("unexpected")))


@query("bbox_overlap", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS x0, l_quantity / 100 + 0.3 AS x1, l_discount AS y0, l_discount + 0.2 AS y1, l_tax AS u, l_tax + 0.4 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(x1, 0.6) - greatest(x0, 0.1)) * greatest(0, least(y1, v) - greatest(y0, u)) / greatest(1e-9, (x1 - x0) * (y1 - y0)), 4) AS overlap FROM b""")
def bbox_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity") / 100, F.col("l_discount"), F.col("l_tax")
    ratio = merge.overlap_ratio({"x0": q, "x1": q + 0.3, "y0": d, "y1": d + 0.2}, {"x0": F.lit(0.1), "x1": F.lit(0.6), "y0": t, "y1": t + 0.4})
    return l.select("l_orderkey", "l_linenumber", F.round(ratio, 4).alias("overlap"))


@query("unique_reference", "WITH f AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS v FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS l_orderkey, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN v END AS value FROM orders LEFT JOIN f ON o_orderkey = f.l_orderkey")
def unique_reference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return merge.unique_match(o, table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").select("l_orderkey", "status", "value")


@query("language_pairs", "WITH l AS (SELECT DISTINCT lang FROM documents) SELECT a.lang AS source_language, b.lang AS target_language FROM l a, l b WHERE a.lang <> b.lang")
def language_pairs(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").agg(F.collect_set("lang").alias("l"))  # a handful
    pairs = langs.select(F.explode("l").alias("source_language"), "l").select("source_language", F.explode("l").alias("target_language"))
    return pairs.where("source_language <> target_language")


@query("order_check", "WITH o AS (SELECT o_custkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders) SELECT o_custkey, count(*) FILTER (back) AS backwards FROM o GROUP BY o_custkey")
def order_check(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("back", F.col("o_orderdate") < F.lag("o_orderdate").over(w)).groupBy("o_custkey").agg(F.count_if("back").alias("backwards"))


@query("section_ordinals", SECTIONS + " SELECT b.doc_id, CAST((b.page - 1) // 7 AS BIGINT) AS section, CAST(row_number() OVER (PARTITION BY b.source, (b.page - 1) // 7 ORDER BY length(b.text), b.doc_id) AS INTEGER) AS ordinal FROM book b")
def section_ordinals(spark, sf_dir):
    p = pages(spark, sf_dir, n=F.length("text")).withColumn("section", F.floor((F.col("page") - 1) / 7))
    return p.select("doc_id", "section", F.row_number().over(Window.partitionBy("source", "section").orderBy("n", "doc_id")).alias("ordinal"))


@query("upper_median", "WITH s AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, q[len(q) // 2 + 1] AS upper_median FROM s")
def upper_median(spark, sf_dir):
    w = Window.partitionBy("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.row_number().over(w.orderBy("l_quantity")).alias("i"), F.count("*").over(w).alias("n"))
    return rows.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("l_suppkey", F.col("l_quantity").alias("upper_median"))


@query("row_groups", "SELECT l_orderkey, string_agg(l_linenumber || ':' || CAST(l_quantity AS INTEGER), '|' ORDER BY l_linenumber, l_quantity) AS cells, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def row_groups(spark, sf_dir):
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(cells, lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["q"].cast("string"))), "|").alias("cells"), F.count("*").alias("n"))


@query("batch_alignment", "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'matched' END AS side, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def batch_alignment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    both = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full")
    return both.groupBy(F.when(F.col("l").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise("matched").alias("side")).agg(F.count("*").alias("n"))
