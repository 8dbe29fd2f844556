"""Queries on notes, regions, provider replies, review and cross-page evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import notes
from quire.functions import text as T
from quire.operators import book, keys, merge, queue
from quire.plans.catalog import BOOK, NEXT, RELATION, pages, query, table


@query("paragraph_types", BOOK + r""", p AS (SELECT source, page, regexp_split_to_array(text, '\n\s*\n') AS ps FROM book), e AS (SELECT source, page, generate_subscripts(ps, 1) AS i, len(ps) AS n, unnest(ps) AS p FROM p), b AS (SELECT *, regexp_replace(p, '^\s+|\s+$', '', 'g') AS bare FROM e)
SELECT source, page, CAST(i - 1 AS INTEGER) AS position, CASE WHEN regexp_matches(bare, '(?m)^\|.*\|\s*$') THEN 'table' WHEN regexp_matches(bare, '^(?:\d{1,3}[.)]|[*†‡])\s+\S') THEN 'footnote' WHEN (i = 1 OR i = n) AND regexp_matches(bare, '(?i)^(?:\d{1,4}|[ivxlcdm]{1,8})[.!]?$') THEN 'pagination'
WHEN i = 1 AND length(bare) <= 60 AND NOT regexp_matches(regexp_replace(bare, '["\x27”’)\]}]+$', ''), '[.!?…]$') THEN 'header' ELSE 'body' END AS kind FROM b""")
def paragraph_types(spark, sf_dir):
    kinds = lambda ps: F.transform(ps, lambda p, i: notes.paragraph_type(p, i == 0, i == F.size(ps) - 1))
    p = pages(spark, sf_dir, kinds=T.let(F.split("text", r"\n\s*\n"), kinds))
    return p.select("source", "page", F.posexplode("kinds").alias("position", "kind"))


@query("note_references", r"SELECT doc_id, array_to_string(regexp_extract_all(replace(text, chr(10), '  ') || '  ', '[.!?…][\"\x27”’)]?(\d{1,3})\s', 1), ',') AS refs, array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)*|[½¼¾⅓⅔⅛]'), '; ') AS numbers FROM documents")
def note_references(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(notes.reference_candidates(t), ",").alias("refs"), notes.raw_numbers(t).alias("numbers"))


@query("note_entries", r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^[ \t]*(\d{1,4})[.)]\s+', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM documents),
e AS (SELECT doc_id, list_filter(list_transform(p, lambda x: {'label': coalesce(TRY_CAST(nullif(regexp_extract(x, '^(\d{1,4})\x02', 1), '') AS INTEGER), 0::INTEGER), 't': regexp_replace(regexp_replace(x, '^\d{1,4}\x02', ''), '^\s+|\s+$', '', 'g')}), lambda x: x.t <> '') AS e FROM p),
u AS (SELECT doc_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM e) SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, x.label AS label, sha256(x.t) AS text_sha256 FROM u""")
def note_entries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(notes.note_entries(F.col("text"))).alias("position", "e")).select("doc_id", "position", "e.label", keys.text_hash(F.col("e.text")).alias("text_sha256"))


@query("note_graph", """WITH n AS (SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey), e AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT o_custkey AS node, count(*) AS edges, count(*) FILTER (n.l_orderkey IS NULL) AS unresolved, coalesce(sum(n.last - n.first + 1), 0)::BIGINT AS reach FROM e LEFT JOIN n ON e.o_orderkey = n.l_orderkey GROUP BY o_custkey""")
def note_graph(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))
    edges = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = edges.join(nodes, edges["o_orderkey"] == nodes["l_orderkey"], "left")
    return both.groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("edges"), F.count_if(F.col("l_orderkey").isNull()).alias("unresolved"), F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).cast("long").alias("reach"))


@query("region_normaliser", """WITH b AS (SELECT l_orderkey, l_quantity / 60 AS x0, l_discount AS y0, l_quantity / 60 + 0.3::DOUBLE AS x1, l_discount + 0.2::DOUBLE AS y1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_tax * 15)) AS c FROM lineitem),
v AS (SELECT *, x0 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x0 < x1 AND y0 < y1 AS ok FROM b)
SELECT l_orderkey, CAST(count(*) FILTER (ok) AS INTEGER) AS kept, CAST(count(*) FILTER (NOT ok) AS INTEGER) AS dropped, bool_or(NOT ok OR c < 0.5) AS review FROM v GROUP BY l_orderkey""")
def region_normaliser(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    box = F.array(F.col("l_quantity") / 60, F.col("l_discount"), F.col("l_quantity") / 60 + 0.3, F.col("l_discount") + 0.2)
    region = F.struct(F.col("l_returnflag").alias("type"), box.alias("bbox"), (F.col("l_tax") * 15).alias("confidence"))
    rows = l.groupBy("l_orderkey").agg(F.collect_list(region).alias("regions")).select("l_orderkey", notes.normalised_regions(F.col("regions")).alias("r"))
    return rows.select("l_orderkey", F.size("r.kept").alias("kept"), "r.dropped", "r.review")


@query("wrapped_lines", """WITH s AS (SELECT l_orderkey, l_linenumber * 0.03::DOUBLE AS y0, l_linenumber * 0.03::DOUBLE + 0.02::DOUBLE AS y1, l_discount AS x0, l_tax + 1 AS font, l_partkey AS tie FROM lineitem),
l AS (SELECT l_orderkey, list({'s': []::INTEGER[], 'n': 1::INTEGER, 'y0': y0, 'y1': y1, 'x0': x0, 'f': font} ORDER BY y0, y1, x0, font, tie) AS l FROM s GROUP BY l_orderkey),
r AS (SELECT l_orderkey, list_reduce(l, lambda a, x: CASE WHEN x.y0 - a.y1 <= 0.02::DOUBLE AND abs(x.x0 - a.x0) <= 0.025::DOUBLE AND abs(x.f - a.f) <= 0.15::DOUBLE * greatest(a.f, 1e-9::DOUBLE)
  THEN {'s': a.s, 'n': a.n + 1::INTEGER, 'y0': x.y0, 'y1': x.y1, 'x0': least(a.x0, x.x0), 'f': (a.f * a.n + x.f) / (a.n + 1)} ELSE {'s': list_append(a.s, a.n), 'n': 1::INTEGER, 'y0': x.y0, 'y1': x.y1, 'x0': x.x0, 'f': x.f} END) AS r FROM l)
SELECT l_orderkey, array_to_string(list_append(r.s, r.n), ',') AS paragraphs FROM r""")
def wrapped_lines(spark, sf_dir):
    line = F.struct((F.col("l_linenumber") * 0.03).alias("y0"), (F.col("l_linenumber") * 0.03 + 0.02).alias("y1"), F.col("l_discount").alias("x0"), (F.col("l_tax") + 1).alias("font"), F.col("l_partkey").alias("tie"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("l_orderkey", F.array_join(notes.wrapped_lines(F.col("lines")).cast("array<string>"), ",").alias("paragraphs"))


@query("boundary_evidence", NEXT + f""", e AS (SELECT source, page, {RELATION.format('text', 'next_text')} AS relation, substr(text, greatest(length(text) - 79, 1)) AS tail, substr(next_text, 1, 80) AS head FROM n WHERE next_text IS NOT NULL)
SELECT source, page, CASE WHEN relation = 'continue' AND regexp_matches(tail, '-\\s*$') THEN 'remove_layout_hyphen' WHEN relation = 'continue' THEN 'insert_space' ELSE 'none' END AS join_operation, CASE relation WHEN 'unresolved' THEN 'needs_review' ELSE 'resolved' END AS status, length(tail) AS tail_chars, length(head) AS head_chars FROM e""")
def boundary_evidence(spark, sf_dir):
    ends = {"marks": T.edge_marks(F.col("text")), "tail": F.right("text", F.lit(80)), "head": F.left("text", F.lit(80))}
    e = book.beside(pages(spark, sf_dir, **ends), "marks", "head").where("next.head is not null")
    relation, tail = T.marks_relation(F.col("marks"), F.col("next.marks")), F.col("tail")
    op = F.when((relation == "continue") & tail.rlike(r"-\s*$"), "remove_layout_hyphen").when(relation == "continue", "insert_space").otherwise("none")
    status = F.when(relation == "unresolved", "needs_review").otherwise("resolved")
    return e.select("source", "page", op.alias("join_operation"), status.alias("status"), F.length(tail).cast("long").alias("tail_chars"), F.length("next.head").cast("long").alias("head_chars"))


@query("evidence_union", "WITH e AS (SELECT doc_id, 'base' AS kind, 0 AS rank, n_chars AS value FROM documents UNION ALL SELECT doc_id, 'label', 1, quality FROM labels UNION ALL SELECT doc_id, 'review', 2, toxic FROM labels WHERE toxic = 1) SELECT doc_id, arg_max(kind, rank) AS kind, arg_max(value, rank) AS value, count(*) AS evidence FROM e GROUP BY doc_id")
def evidence_union(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    row = lambda df, kind, rank, value: df.select("doc_id", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.col(value).cast("long").alias("value"))
    e = row(d, "base", 0, "n_chars").unionByName(row(l, "label", 1, "quality")).unionByName(row(l.where("toxic = 1"), "review", 2, "toxic"))
    return e.groupBy("doc_id").agg(F.max_by("kind", "rank").alias("kind"), F.max_by("value", "rank").alias("value"), F.count("*").alias("evidence"))


@query("positional_zip", "WITH a AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey FROM orders), b AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events) SELECT a.k, CAST(a.n AS INTEGER) AS n, o_orderkey, event_id FROM a JOIN b ON a.k = b.k AND a.n = b.n")
def positional_zip(spark, sf_dir):
    nth = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy(o)).alias("n")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), nth("o_custkey", "o_orderkey"), "o_orderkey")
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), nth("user_id", "event_id"), "event_id")
    return a.join(b, ["k", "n"])


@query("orphan_rows", "SELECT 'line_without_order' AS problem, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_without_line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_rows(spark, sf_dir):
    o, l, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    lacking = lambda a, x, b, y, name: a.join(b, a[x] == b[y], "left_anti").agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    return lacking(l, "l_orderkey", o, "o_orderkey", "line_without_order").unionByName(lacking(o, "o_orderkey", l, "l_orderkey", "order_without_line")).unionByName(lacking(o, "o_custkey", c, "c_custkey", "order_without_customer"))


@query("reference_comparison", "SELECT l_orderkey, l_linenumber, p.p_partkey, array_to_string(list_filter([CASE WHEN l_quantity <> p_size THEN 'quantity' END, CASE WHEN l_extendedprice < p_retailprice THEN 'price' END], lambda x: x IS NOT NULL), ',') AS differing FROM lineitem JOIN part p ON l_partkey = p.p_partkey")
def reference_comparison(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    differing = F.array_compact(F.array(F.when(F.col("l_quantity") != F.col("p_size"), "quantity"), F.when(F.col("l_extendedprice") < F.col("p_retailprice"), "price")))
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select("l_orderkey", "l_linenumber", "p_partkey", F.array_join(differing, ",").alias("differing"))


@query("neighbour_roles", BOOK + ", n AS (SELECT a.source, a.page, b.page AS p, b.lang FROM book a JOIN book b ON a.source = b.source AND b.page BETWEEN a.page - 2 AND a.page + 2 AND b.page <> a.page) SELECT source, page, string_agg(lang, ',' ORDER BY p) AS roles FROM n GROUP BY source, page")
def neighbour_roles(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("page")
    near = F.array_compact(F.array(*(F.lag("lang", -o).over(w) for o in (-2, -1, 1, 2))))
    return pages(spark, sf_dir).select("source", "page", F.array_join(near, ",").alias("roles")).where("roles <> ''")


@query("attempt_ledger", "SELECT l_suppkey, l_returnflag, count(*) AS attempts, count(DISTINCT l_orderkey) AS jobs, round(avg(l_extendedprice), 2) AS mean_cost, arg_max(l_linestatus, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey)) AS last_status FROM lineitem GROUP BY ALL")
def attempt_ledger(spark, sf_dir):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("attempts"), F.count_distinct("l_orderkey").alias("jobs"), F.round(F.avg("l_extendedprice"), 2).alias("mean_cost"), F.max_by("l_linestatus", order).alias("last_status"))


@query("worklist_flags", "WITH f AS (SELECT doc_id, 'short' AS flag FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'low_quality' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'digits' FROM documents WHERE regexp_matches(text, '\\d{6,}')) SELECT doc_id, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags, count(DISTINCT flag) AS n FROM f GROUP BY doc_id")
def worklist_flags(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flag = lambda df, where, name: df.where(where).select("doc_id", F.lit(name).alias("flag"))
    f = flag(d, F.col("n_chars") < 200, "short").unionByName(flag(l, F.col("quality") == 0, "low_quality")).unionByName(flag(l, F.col("toxic") == 1, "toxic")).unionByName(flag(d, F.col("text").rlike(r"\d{6,}"), "digits"))
    return f.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.count_distinct("flag").alias("n"))


@query("caption_order", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS order_of_roles, count(*) AS blocks, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def caption_order(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("order_of_roles"), F.count("*").alias("blocks"), F.min("turn").alias("first_turn"))


@query("provider_pick", "SELECT s_suppkey, n_name, r_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey QUALIFY rank <= 3")
def provider_pick(spark, sf_dir):
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select("s_suppkey", "n_name", "r_name", rank.alias("rank")).where("rank <= 3")


@query("boundary_dedupe", "WITH u AS (SELECT l_orderkey AS k, l_partkey AS v, 0 AS origin FROM lineitem UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders) SELECT k, v, min(origin) AS origin, count(*) AS n FROM u GROUP BY k, v")
def boundary_dedupe(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"), F.lit(0).alias("origin")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit(1).alias("origin")))
    return u.groupBy("k", "v").agg(F.min("origin").alias("origin"), F.count("*").alias("n"))
