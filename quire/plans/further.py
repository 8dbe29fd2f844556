"""More queries: imports, folds, placeholders, audits, incremental runs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import folds, similarity
from quire.functions import text as T
from quire.operators import book, keys, merge, queue
from quire.plans.catalog import ACCEPTANCE, BOOK, NEXT, RELATION, jobs, pages, query, table, texts
from quire.sources import files
from quire.streaming import events as streams


@query("import_codes", """WITH s AS (SELECT doc_id, lang, sha256(text) AS sha256, length(trim(text)) = 0 AS blank, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) AS b FROM documents)
SELECT doc_id, 'source_' || substr(sha256, 1, 24) AS source_id, CASE WHEN blank THEN 'unreadable' WHEN a = 1 THEN 'accepted' WHEN b > 1 THEN 'duplicate_in_project' ELSE 'reused_immutable_source' END AS code FROM s""")
def import_codes(spark, sf_dir):
    return files.import_codes(table(spark, sf_dir, "documents"), "lang", "doc_id", "text").select("doc_id", "source_id", "code")


@query("import_summary", """WITH s AS (SELECT lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) AS b FROM documents)
SELECT lang, count(*) FILTER (a = 1) AS accepted, count(*) FILTER (a > 1 AND b > 1) AS duplicate_in_project, count(*) FILTER (a > 1 AND b = 1) AS reused FROM s GROUP BY lang""")
def import_summary(spark, sf_dir):
    rows = files.import_codes(table(spark, sf_dir, "documents"), "lang", "doc_id", "text")
    n = lambda code: F.count_if(F.col("code") == code)
    return rows.groupBy("lang").agg(n("accepted").alias("accepted"), n("duplicate_in_project").alias("duplicate_in_project"), n("reused_immutable_source").alias("reused"))


@query("page_inspection", "SELECT source, min(length(text))::INTEGER AS min_chars, max(length(text))::INTEGER AS max_chars, round_even(avg(length(text)), 2) AS mean_chars, sum(length(text))::BIGINT AS chars, bool_or(length(text) > 0) AS has_text_layer FROM documents GROUP BY source")
def page_inspection(spark, sf_dir):
    return files.inspect_pages(table(spark, sf_dir, "documents"), "source")


@query("row_clusters", """WITH q AS (SELECT l_orderkey, list_transform(list_sort(list(l_quantity)), lambda x: {'s': []::INTEGER[], 'f': x, 'n': 1::INTEGER}) AS l FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, list_reduce(l, lambda a, x: CASE WHEN abs(x.f - a.f) <= 5.0 THEN {'s': a.s, 'f': a.f, 'n': a.n + 1::INTEGER} ELSE {'s': list_append(a.s, a.n), 'f': x.f, 'n': 1::INTEGER} END) AS r FROM q)
SELECT l_orderkey, CAST(len(r.s) + 1 AS INTEGER) AS clusters, array_to_string(list_append(r.s, r.n), ',') AS sizes FROM r""")
def row_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    groups = folds.clusters_from_first(F.col("q"), 5.0)
    return rows.select("l_orderkey", F.size(groups).alias("clusters"), F.array_join(F.transform(groups, lambda g: F.size(g).cast("string")), ",").alias("sizes"))


@query("mean_clusters", """WITH q AS (SELECT l_orderkey, list_transform(list_sort(list(l_quantity)), lambda x: {'s': []::INTEGER[], 't': x, 'n': 1::INTEGER}) AS l FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, list_reduce(l, lambda a, x: CASE WHEN abs(x.t - a.t / a.n) <= 4.5 THEN {'s': a.s, 't': a.t + x.t, 'n': a.n + 1::INTEGER} ELSE {'s': list_append(a.s, a.n), 't': x.t, 'n': 1::INTEGER} END) AS r FROM q)
SELECT l_orderkey, array_to_string(list_append(r.s, r.n), ',') AS sizes FROM r""")
def mean_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return rows.select("l_orderkey", F.array_join(folds.clusters_from_mean(F.col("q"), 4.5).cast("array<string>"), ",").alias("sizes"))


@query("placeholders", "SELECT page_id, sha256(html) AS restored, true AS complete FROM pages")
def placeholders(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "html", folds.protected(F.col("html")).alias("p"))
    back = folds.restored(F.col("p.text"), F.col("p.terms"))
    return rows.select("page_id", keys.text_hash(back).alias("restored"), (F.coalesce(back, F.lit("")) == F.col("html")).alias("complete"))


@query("book_sections", BOOK + """, k AS (SELECT source, page, CASE WHEN length(text) < 60 THEN 'blank' WHEN doc_id % 13 = 0 THEN 'chapter' WHEN doc_id % 17 = 0 THEN 'appendix' ELSE 'body' END AS kind FROM book),
l AS (SELECT source, list(page ORDER BY page) AS pages, list(kind ORDER BY page) AS kinds FROM k GROUP BY source), e AS (SELECT *, list_transform(kinds, lambda x: {'o': [1::INTEGER], 'n': 1::INTEGER, 'w': CASE WHEN x = 'body' THEN 'chapter' ELSE x END, 'k': x}) AS s FROM l),
r AS (SELECT *, list_reduce(s, lambda a, x: CASE WHEN x.k = 'blank' OR (x.k = 'body' AND a.w = 'chapter') OR (x.k = a.w AND x.k NOT IN ('chapter', 'blank')) THEN {'o': list_append(a.o, a.n), 'n': a.n, 'w': a.w, 'k': x.k} ELSE {'o': list_append(a.o, a.n + 1::INTEGER), 'n': a.n + 1::INTEGER, 'w': x.w, 'k': x.k} END) AS r FROM e)
SELECT source, unnest(pages) AS page, unnest(kinds) AS kind, unnest(r.o) AS section FROM r""")
def book_sections(spark, sf_dir):
    kind = F.when(F.length("text") < 60, "blank").when(F.col("doc_id") % 13 == 0, "chapter").when(F.col("doc_id") % 17 == 0, "appendix").otherwise("body")
    return book.sections(pages(spark, sf_dir, kind=kind)).select("source", "page", "kind", "section")


@query("index_tree", """WITH l AS (SELECT conv_id, list({'turn': turn, 'level': CAST(length(text) % 3 AS INTEGER)} ORDER BY turn, length(text) % 3) AS e FROM conversations GROUP BY conv_id),
s AS (SELECT *, list_transform(e, lambda x: {'p': [0::INTEGER], 'a': CASE WHEN x.level = 0 THEN 1::INTEGER ELSE 0::INTEGER END, 'b': CASE WHEN x.level = 1 THEN 1::INTEGER ELSE 0::INTEGER END, 'i': 1::INTEGER, 'l': x.level}) AS s FROM l),
r AS (SELECT *, list_reduce(s, lambda a, x: {'p': list_append(a.p, CASE x.l WHEN 0 THEN 0::INTEGER WHEN 1 THEN a.a ELSE a.b END), 'a': CASE WHEN x.l = 0 THEN a.i + 1::INTEGER ELSE a.a END, 'b': CASE x.l WHEN 0 THEN 0::INTEGER WHEN 1 THEN a.i + 1::INTEGER ELSE a.b END, 'i': a.i + 1::INTEGER, 'l': x.l}) AS r FROM s)
SELECT conv_id, unnest(list_transform(e, lambda x: x.turn)) AS turn, unnest(list_transform(e, lambda x: x.level)) AS level, unnest(r.p) AS parent FROM r""")
def index_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 3).alias("level")))).alias("e"))
    return rows.select("conv_id", F.explode(F.arrays_zip(F.col("e.turn").alias("turn"), F.col("e.level").alias("level"), folds.index_parents(F.col("e.level")).alias("parent"))).alias("r")).select("conv_id", "r.*")


@query("edge_similarity")
def edge_similarity(spark, sf_dir):
    edges = book.beside(pages(spark, sf_dir, tail=F.right("text", F.lit(80)), head=F.left("text", F.lit(80))), "head").where("next.head is not null")
    return edges.select("source", "page", F.round(similarity.similarity(F.col("tail"), F.col("next.head")), 6).alias("similarity"))


@query("translation_fidelity", "SELECT a.doc_id, CASE WHEN a.lang <> b.lang AND length(a.text) >= 4 AND a.text = b.text THEN 'source_echo' END AS violation FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def translation_fidelity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t"), F.col("lang").alias("l")), "doc_id")
    return both.select("doc_id", similarity.fidelity(F.col("text"), F.col("t"), F.col("lang"), F.col("l")).alias("violation"))


@query("continuity_signals", NEXT + r""", e AS (SELECT source, page, regexp_replace(regexp_replace(text, '\s+$', ''), '["\x27”’)\]}]+$', '') AS ending, regexp_matches(text, '-\s*$') AS hyphen, regexp_matches(regexp_extract(next_text, '\p{L}'), '\p{Ll}') AS low FROM n WHERE next_text IS NOT NULL)
SELECT source, page, hyphen AND low IS NOT NULL AS word_break, ending <> '' AND NOT regexp_matches(ending, '[.!?;:]$') AS sentence, coalesce(low, false) AS next_lowercase FROM e""")
def continuity_signals(spark, sf_dir):
    ending = F.regexp_replace(T.rstrip(F.col("text")), T.CLOSERS, "")
    marks = {"hyphen": T.rstrip(F.col("text")).endswith("-"), "sentence": (ending != "") & ~T.last_char(ending).isin(".", "!", "?", ";", ":"), "letter": F.regexp_extract("text", r"\p{L}", 0)}
    e = book.beside(pages(spark, sf_dir, **marks), "letter").where("next.letter is not null")
    first = F.col("next.letter")
    return e.select("source", "page", (F.col("hyphen") & (first != "")).alias("word_break"), "sentence", first.rlike(r"\p{Ll}").alias("next_lowercase"))


@query("route_policy", "SELECT doc_id, CASE WHEN length(text) < 60 THEN 'omit' WHEN lang = 'en' THEN 'keep' WHEN length(text) > 4000 THEN 'split' ELSE 'translate' END AS route, length(text) >= 60 AND lang <> 'en' AS calls_model FROM documents")
def route_policy(spark, sf_dir):
    n, lang = F.length("text"), F.col("lang")
    route = F.when(n < 60, "omit").when(lang == "en", "keep").when(n > 4000, "split").otherwise("translate")
    return table(spark, sf_dir, "documents").select("doc_id", route.alias("route"), ((n >= 60) & (lang != "en")).alias("calls_model"))


@query("translatable_units", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'body' WHEN 'assistant' THEN 'body' ELSE 'other_translatable' END AS kind, count(*) AS n FROM conversations WHERE length(trim(text)) > 0 GROUP BY ALL")
def translatable_units(spark, sf_dir):
    kind = F.when(F.col("role").isin("user", "assistant"), "body").otherwise("other_translatable")
    return table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0).groupBy("conv_id", "turn", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("reading_order", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS place FROM lineitem")
def reading_order(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(rank, "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"))


@query("fragment_audit", NEXT + f""", e AS (SELECT source, page, {RELATION.format('text', 'next_text')} AS relation FROM n) SELECT source, count(*) AS fragments, count(*) FILTER (relation = 'continue') AS joined, count(*) FILTER (relation = 'unresolved') AS unresolved, count(*) FILTER (relation = 'no_join') AS closed FROM e GROUP BY source""")
def fragment_audit(spark, sf_dir):
    n = lambda r: F.count_if(F.col("relation") == r)
    return book.page_edges(texts(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("fragments"), n("continue").alias("joined"), n("unresolved").alias("unresolved"), n("no_join").alias("closed"))


@query("quality_gate", """WITH c AS (SELECT count(*) = count(DISTINCT doc_id) AS unique_ids, bool_and(length(text) > 0) AS no_blank, bool_and(n_chars = length(text)) AS lengths_agree, bool_and(lang IN ('en', 'de', 'fr', 'es')) AS known_languages FROM documents)
SELECT unnest(['unique_ids', 'no_blank', 'lengths_agree', 'known_languages', 'all']) AS name, unnest([unique_ids, no_blank, lengths_agree, known_languages, unique_ids AND no_blank AND lengths_agree AND known_languages]) AS passed FROM c""")
def quality_gate(spark, sf_dir):
    c = table(spark, sf_dir, "documents").agg(
        (F.count("*") == F.count_distinct("doc_id")).alias("unique_ids"), F.every(F.length("text") > 0).alias("no_blank"), F.every(F.col("n_chars") == F.length("text")).alias("lengths_agree"), F.every(F.col("lang").isin("en", "de", "fr", "es")).alias("known_languages")
    )
    names = c.columns
    both = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in names), F.struct(F.lit("all").alias("name"), (F.col(names[0]) & F.col(names[1]) & F.col(names[2]) & F.col(names[3])).alias("passed")))
    return c.select(F.explode(both).alias("r")).select("r.*")


@query("incremental_run", """WITH s AS (SELECT d.doc_id, l.quality, d.text, first_value(d.doc_id) OVER (PARTITION BY d.text ORDER BY d.doc_id) AS head FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN quality = 1 THEN 'cached' WHEN quality = 0 THEN 'quarantined' WHEN length(trim(text)) = 0 THEN 'blank' WHEN head < doc_id THEN 'reused' ELSE 'pending' END AS split FROM s""")
def incremental_run(spark, sf_dir):
    # a text is its hash, so that neither a window nor an exchange holds texts, and many copies of one are counted where they are read
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim("text")) == 0).alias("blank"), F.coalesce(keys.text_hash(F.col("text")), F.lit("")).alias("h"))
    d = d.join(d.groupBy("h").agg(F.min("doc_id").alias("head")), "h").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    split = F.when(F.col("quality") == 1, "cached").when(F.col("quality") == 0, "quarantined").when(F.col("blank"), "blank").when(F.col("head") < F.col("doc_id"), "reused").otherwise("pending")
    return d.select("doc_id", split.alias("split"))


@query("resume_point", BOOK + ", t AS (SELECT source, page FROM book JOIN labels USING (doc_id)) SELECT b.source, min(b.page) AS resume_page, count(*) AS open_pages FROM book b LEFT JOIN t USING (source, page) WHERE t.page IS NULL GROUP BY b.source")
def resume_point(spark, sf_dir):
    open_pages = pages(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return open_pages.groupBy("source").agg(F.min("page").alias("resume_page"), F.count("*").alias("open_pages"))


@query("crash_recovery", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'queued' ELSE 'completed' END AS state, o_orderstatus = 'P' AS recovered FROM orders")
def crash_recovery(spark, sf_dir):
    state = F.col("state")
    return jobs(spark, sf_dir).select("o_orderkey", F.when(state == "paused", "queued").otherwise(state).alias("state"), (state == "paused").alias("recovered"))


@query("backlinks", "SELECT l_partkey, l_orderkey, count(*) AS refs FROM lineitem GROUP BY l_partkey, l_orderkey")
def backlinks(spark, sf_dir):
    """A row for each note and what refers to it, with how often: no list grows with its group."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("refs"))


@query("occurrence_numbers", "SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS INTEGER) AS nth FROM events")
def occurrence_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")).alias("nth"))


@query("bilingual_split", "SELECT conv_id, turn, role, len(list_filter(string_split(text, ' / '), lambda x: NOT regexp_matches(x, '[㐀-鿿]'))) AS latin_parts FROM conversations")
def bilingual_split(spark, sf_dir):
    parts = F.filter(F.split("text", " / "), lambda x: ~x.rlike("[㐀-鿿]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(parts).cast("long").alias("latin_parts"))


@query("paragraphs", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: length(trim(x)) > 0)) AS paragraphs, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS lines FROM documents")
def paragraphs(spark, sf_dir):
    kept = F.filter(F.split("text", r"\n\s*\n"), lambda x: F.length(F.trim(x)) > 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("paragraphs"), F.size(T.lines(F.col("text"))).cast("long").alias("lines"))


@query("substring_reuse", "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def substring_reuse(spark, sf_dir):
    """Documents that hold a benchmark text whole."""
    return merge.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("event_stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_stream_windows(spark, sf_dir):
    return streams.drained(streams.windowed_counts(streams.event_stream(spark, sf_dir)), "complete").select("start", "event_type", "events", F.round("total", 4).alias("total"))


@query("event_stream_acceptance", "WITH RECURSIVE e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS arrival, event_id // 3 AS event_id, CAST(event_id // 400 + 1 AS BIGINT) AS sequence, event_id % 17 <> 5 AS matches FROM events)" + ACCEPTANCE + " SELECT stream, event_id, sequence, decision FROM r")
def event_stream_acceptance(spark, sf_dir):
    n = F.col("event_id")
    rows = streams.event_stream(spark, sf_dir).select(F.col("user_id").alias("stream"), F.floor(n / 3).alias("event_id"), (F.floor(n / 400) + 1).alias("sequence"), n.alias("arrival"), (n % 17 != 5).alias("matches"))
    return streams.drained(streams.accepted(rows))


#: As the acceptance of events, but for rows that are snapshots: they set the cursor and forget the ids.
RESETS = ACCEPTANCE.replace("CASE WHEN NOT matches THEN 'schema_mismatch' WHEN sequence <= 0", "CASE WHEN snapshot THEN 'snapshot' WHEN NOT matches THEN 'schema_mismatch' WHEN sequence <= 0").replace(
    "CASE WHEN matches AND sequence > 0 THEN sequence ELSE 0 END AS cursor, CASE WHEN matches AND", "CASE WHEN snapshot OR (matches AND sequence > 0) THEN sequence ELSE 0 END AS cursor, CASE WHEN NOT snapshot AND matches AND"
).replace("CASE WHEN s.d = 'accepted' THEN s.sequence ELSE s.cursor END, CASE WHEN", "CASE WHEN s.d IN ('accepted', 'snapshot') THEN s.sequence ELSE s.cursor END, CASE WHEN s.d = 'snapshot' THEN [] WHEN").replace(
    "CASE WHEN NOT e.matches THEN", "CASE WHEN e.snapshot THEN 'snapshot' WHEN NOT e.matches THEN"
)
STORE_SQL = "WITH RECURSIVE e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS arrival, event_id // 3 AS event_id, CAST(event_id // 300 + 1 AS BIGINT) AS sequence, event_id % 17 <> 5 AS matches, event_type = 'signup' AND event_id % 4 = 1 AS snapshot FROM events)" + RESETS


def stored_events(events):
    n = F.col("event_id")
    snapshot = (F.col("event_type") == "signup") & (n % 4 == 1)
    return events.select(F.col("user_id").alias("stream"), F.floor(n / 3).alias("event_id"), (F.floor(n / 300) + 1).alias("sequence"), n.alias("arrival"), (n % 17 != 5).alias("matches"), snapshot.alias("snapshot"))


@query("event_store", STORE_SQL + " SELECT stream, event_id, sequence, decision FROM r")
def event_store(spark, sf_dir):
    """Decisions on a stream of events whose snapshots reset the cursor and what was seen."""
    return streams.drained(streams.stored(stored_events(streams.event_stream(spark, sf_dir))))


@query("event_store_batch", STORE_SQL + " SELECT stream, event_id, sequence, decision FROM r")
def event_store_batch(spark, sf_dir):
    """The same decisions over the table at rest."""
    return queue.accepted(stored_events(table(spark, sf_dir, "events"))).drop("arrival")
