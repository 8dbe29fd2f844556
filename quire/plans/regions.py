"""Queries on boxes of pages, texts aligned with one another, notes over a book, and logs of what was applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import alignment, contracts
from quire.functions import text as T
from quire.operators import book, components, note_scan, overlays, regions
from quire.plans.catalog import BOOK, pages, query, table, texts

#: Boxes made of a line item: its part is the page.
LINE_BOX = {
    "x0": "l_discount * 8::DOUBLE", "y0": "l_tax * 10::DOUBLE", "x1": "l_discount * 8::DOUBLE + (l_quantity / 100::DOUBLE + 0.05::DOUBLE)", "y1": "l_tax * 10::DOUBLE + (l_linenumber / 20::DOUBLE + 0.05::DOUBLE)",
}
BOXES = "WITH b AS (SELECT DISTINCT l_partkey AS page, l_orderkey AS id, l_returnflag AS flag, " + ", ".join(f"{sql} AS {name}" for name, sql in LINE_BOX.items()) + " FROM lineitem)"
COMMON = "greatest(0.0::DOUBLE, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0::DOUBLE, least(a.y1, c.y1) - greatest(a.y0, c.y0))"
OF_LEFT, OF_SMALLER = (f"{COMMON} / greatest({base}, 1e-9::DOUBLE)" for base in ("(a.x1 - a.x0) * (a.y1 - a.y0)", "least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0))"))


def boxes(spark, sf_dir):
    col = lambda name: F.col(f"l_{name}")
    x0, y0 = col("discount") * 8.0, col("tax") * 10.0
    rows = table(spark, sf_dir, "lineitem").select(
        col("partkey").alias("page"), col("orderkey").alias("id"), col("returnflag").alias("flag"), x0.alias("x0"), y0.alias("y0"), (x0 + (col("quantity") / 100.0 + 0.05)).alias("x1"), (y0 + (col("linenumber") / 20.0 + 0.05)).alias("y1")
    )
    return rows.distinct()


#: Kind of region: its flags, and the share of a block that it must cover.
KINDS = {"caption": (["A"], 0.35), "visual": (["R"], 0.40), "semantic": (["A", "R"], 0.35)}


@query("region_matches", BOXES + " SELECT a.page, a.id, " + ", ".join(f"min(c.id) FILTER (c.flag IN ({', '.join(f'{chr(39)}{f}{chr(39)}' for f in flags)}) AND {OF_LEFT} >= {share}::DOUBLE) AS {kind}" for kind, (flags, share) in KINDS.items())
+ " FROM b a LEFT JOIN b c ON c.page = a.page AND c.flag <> 'N' WHERE a.flag = 'N' GROUP BY a.page, a.id, a.x0, a.y0, a.x1, a.y1")
def region_matches(spark, sf_dir):
    """For each block of a page the first caption, visual and semantic region that covers enough of it."""
    rows = boxes(spark, sf_dir)
    kinds = {kind: (lambda r, flags=flags: r["flag"].isin(flags), share) for kind, (flags, share) in KINDS.items()}
    return regions.matches(rows.where("flag = 'N'").drop("flag"), rows.where("flag <> 'N'"), ["page"], kinds, ("flag",)).select("page", "id", *KINDS)


@query("confirmed_regions", BOXES + f" SELECT a.page, a.id, coalesce(bool_or({OF_SMALLER} >= 0.5::DOUBLE), true) AS confirmed FROM b a LEFT JOIN b c ON c.page = a.page AND c.flag = 'A' WHERE a.flag <> 'A' GROUP BY a.page, a.id, a.flag, a.x0, a.y0, a.x1, a.y1")
def confirmed_regions(spark, sf_dir):
    """Whether a region is borne out by a candidate of its page; pages without candidates bear out all."""
    rows = boxes(spark, sf_dir)
    return regions.confirmed(rows.where("flag <> 'A'"), rows.where("flag = 'A'").drop("flag"), ["page"]).select("page", "id", "confirmed")


def unit_pages(spark, sf_dir):
    """Conversations as units of pages, a turn a page: the unit's text, from which some pages have lost words, and the pages' own."""
    t, n = F.coalesce("text", F.lit("")), F.col("turn")
    # the first two words gone; all words gone; all in upper case
    held = F.when(n % 4 == 1, F.regexp_replace(t, r"^\s*\S+\s+\S+", "")).when(n % 7 == 3, "").when(n % 5 == 2, F.upper(t)).otherwise(t)
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct(n.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), t.alias("page"), held.alias("held")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.array_join(F.col("t.held"), " ").alias("source"), F.col("t.page").alias("pages"), F.col("t.turn").alias("turns"))


@query("page_offsets")
def page_offsets(spark, sf_dir):
    """Where each page of a unit begins in its text, and how that was found."""
    rows = unit_pages(spark, sf_dir).select("conv_id", F.explode(alignment.page_offsets(F.col("source"), F.col("pages"))).alias("o"))
    return rows.select("conv_id", "o.place", "o.offset", "o.accuracy")


@query("interior_markers")
def interior_markers(spark, sf_dir):
    """Translations with the markers of their source's pages; pages of every fifth turn have no printed number."""
    rows = unit_pages(spark, sf_dir)
    target = F.translate("source", ".!?;", "。！？；")
    labels = F.transform("turns", lambda n: F.when(n % 5 != 4, n.cast("string")))
    marked = alignment.with_markers(target, alignment.page_offsets(F.col("source"), F.col("pages")), F.length("source"), labels)
    return rows.select("conv_id", marked.alias("m")).select("conv_id", F.sha2(F.col("m.text").cast("binary"), 256).alias("text_sha256"), F.size("m.placed").alias("markers"))


def compared_pages(spark, sf_dir):
    """Documents against a text layer that lost the first word of each sentence and has a stray sign at commas."""
    layer = F.regexp_replace(F.regexp_replace("text", r"([.!?]) +\S+", "$1"), ", ", " ,- ")
    docs = texts(spark, sf_dir).withColumn("layer", layer)
    orders = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), lambda i: F.when(F.col("doc_id") % 3 == 0, -i).otherwise(i))
    return docs.select("doc_id", "text", "layer", F.regexp_extract("text", r"^\S+ \S+", 0).alias("header"), (F.col("doc_id") % 100).cast("string").alias("number"), orders.alias("orders"))


@query("page_comparison")
def page_comparison(spark, sf_dir):
    """What a page's recognised text and its text layer have and miss of each other."""
    # texts reach the workers in batches of a few MB, unless the session asks for still smaller ones
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if int(spark.conf.get(name).rstrip("b")) > most:
        spark.conf.set(name, most)
    c = [F.col(x) for x in ("text", "layer", "header", "number", "orders")]
    return compared_pages(spark, sf_dir).select("doc_id", alignment.compared(*c).alias("c")).select("doc_id", "c.*")


#: Orders as imports and undos of scopes, their lines as what they set; customers' nations as the items.
OVERLAY_SQL = """WITH g AS (SELECT o_custkey % 40 AS scope, o_orderkey AS "at", CASE WHEN o_orderkey % 5 = 2 THEN 'undo' ELSE 'import' END AS action, sha256(o_orderpriority || CAST(floor(o_totalprice / 4000) AS BIGINT)) AS sha FROM orders),
a AS (SELECT *, action = 'import' AND row_number() OVER (PARTITION BY scope, action, sha ORDER BY "at") > 1 AS again FROM g),
d AS (SELECT *, CASE WHEN again THEN 0 WHEN action = 'import' THEN 1 ELSE -1 END AS step FROM a), s AS (SELECT *, sum(step) OVER w AS total FROM d WINDOW w AS (PARTITION BY scope ORDER BY "at")),
f AS (SELECT *, least(0, min(total) OVER (PARTITION BY scope ORDER BY "at")) AS low FROM s), i AS (SELECT *, step = -1 AND low < lag(low, 1, 0) OVER (PARTITION BY scope ORDER BY "at") AS idle FROM f),
l AS (SELECT *, CASE WHEN NOT again AND NOT idle THEN total - low + CASE WHEN step = -1 THEN 1 ELSE 0 END END AS level FROM i),
t AS (SELECT scope, "at", action, sha, CASE WHEN again THEN 'already_applied' WHEN idle THEN 'nothing_to_undo' WHEN action = 'undo' THEN 'undo' WHEN lead(action) OVER (PARTITION BY scope, level ORDER BY "at") = 'undo' THEN 'undone' ELSE 'applied' END AS status FROM l),
b AS (SELECT DISTINCT c_custkey % 40 AS scope, c_nationkey AS item, unnest(['A', 'N', 'R']) AS field, 'base' AS value FROM customer),
p AS (SELECT DISTINCT o_custkey % 40 AS scope, l_orderkey AS "at", CAST(l_partkey % 30 AS INTEGER) AS item, l_returnflag AS field, l_linenumber AS place, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
z AS (SELECT b.scope, b.item, b.field, coalesce(m.value, b.value) AS value FROM b LEFT JOIN (SELECT p.scope, p.item, p.field, arg_max(value, (p."at", place, value)) AS value FROM p JOIN t ON t.scope = p.scope AND t."at" = p."at" AND status = 'applied' GROUP BY ALL) m USING (scope, item, field))"""


def overlay_tables(spark, sf_dir):
    """(log, base, patches)."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    scope = (F.col("o_custkey") % 40).alias("scope")
    sha = F.sha2(F.concat("o_orderpriority", F.floor(F.col("o_totalprice") / 4000).cast("string")).cast("binary"), 256)
    log = orders.select(scope, key.alias("at"), F.when(key % 5 == 2, "undo").otherwise("import").alias("action"), sha.alias("sha"))
    fields = F.explode(F.array(*map(F.lit, "ANR"))).alias("field")
    base = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("scope"), F.col("c_nationkey").alias("item"), fields, F.lit("base").alias("value")).distinct()
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    patches = lines.select(scope, key.alias("at"), (F.col("l_partkey") % 30).cast("int").alias("item"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("place"), F.col("l_quantity").cast("long").cast("string").alias("value"))
    # of patches alike the largest is the same, so they need not be told apart
    return log, base, patches


@query("application_log", OVERLAY_SQL + " SELECT * FROM t")
def application_log(spark, sf_dir):
    """What became of every import and undo."""
    return overlays.in_force(overlay_tables(spark, sf_dir)[0])


@query("overlay_state", OVERLAY_SQL + " SELECT * FROM z")
def overlay_state(spark, sf_dir):
    """The items with what is in force."""
    log, base, patches = overlay_tables(spark, sf_dir)
    return overlays.state(base, log, patches)


@query("overlay_preview", OVERLAY_SQL + """, n AS (SELECT p.scope, p.item, p.field, arg_max(value, (p."at", place, value)) AS new_value FROM p JOIN t ON t.scope = p.scope AND t."at" = p."at" AND status = 'undone' GROUP BY ALL)
SELECT scope, item, field, z.value AS old_value, new_value, CASE WHEN z.scope IS NULL THEN 'unknown_item' ELSE 'changed' END AS kind FROM n LEFT JOIN z USING (scope, item, field) WHERE z.value IS DISTINCT FROM new_value""".replace("SELECT scope, item, field, z.value", "SELECT n.scope, n.item, n.field, z.value").replace("z.scope IS NULL", "z.value IS NULL"))
def overlay_preview(spark, sf_dir):
    """What it would change to import again all that was taken back."""
    log, base, patches = overlay_tables(spark, sf_dir)
    undone = overlays.in_force(log).where("status = 'undone'").select("scope", "at").join(patches, ["scope", "at"])
    return overlays.preview(overlays.state(base, log, patches), undone.select("scope", "item", "field", F.struct("at", "place").alias("place"), "value"))


def noted_blocks(spark, sf_dir):
    """Pages as two blocks: their first sentences, with references behind some, and a heading or what may be notes; the headings and
    numbers are put in by the page's id, the texts are the table's."""
    n = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    body = F.regexp_replace(F.regexp_replace(F.left(text, F.lit(600)), r"([.!?]) ", F.concat(F.lit("$1"), (n % 31 + 1).cast("string"), F.lit(" "))), r"(\w),", "$1*,")
    rows = F.slice(F.filter(F.split(F.left(text, F.lit(900)), r"(?<=[.!?]) "), lambda x: x != ""), 1, 6)
    # numbers run on from page to page, now and then one jumps or is misread
    number = lambda i: F.when((n + i) % 19 == 4, "l2").when((n + i) % 23 == 1, "99").otherwise((n % 31 + i).cast("string"))
    notes = F.array_join(F.transform(rows, lambda x, i: F.when((n + i) % 7 == 6, x).otherwise(F.concat(number(i), F.lit(". "), x))), "\n")
    second = F.when(n % 37 == 5, "Notes to Chapter 3").when(n % 53 == 7, "Notes").when(n % 41 == 3, "Chapter 9").when(n % 11 == 2, F.concat(F.lit("† "), F.left(text, F.lit(50)))).otherwise(notes)
    numbered = pages(spark, sf_dir, body=body, second=second)
    place = F.explode(F.array(F.struct(F.lit(1).alias("place"), F.col("body").alias("text")), F.struct(F.lit(2).alias("place"), F.col("second").alias("text")))).alias("b")
    return numbered.select(F.col("source").alias("book"), "page", place, (n % 41 == 3).alias("chapter_boundary"), (n % 11 == 2).alias("second_is_footnote")).select(
        "book", "page", "b.place", "b.text", "chapter_boundary", (F.col("second_is_footnote") & (F.col("b.place") == 2)).alias("footnote")
    )


@query("note_blocks")
def note_blocks(spark, sf_dir):
    """Headings of notes and the blocks in their scope."""
    return note_scan.note_blocks(noted_blocks(spark, sf_dir)).select("book", "page", "place", "element", "scope", F.col("opened.page").alias("section_page"))


@query("note_plans")
def note_plans(spark, sf_dir):
    """The notes of a book, numbers that jump folded into the note before."""
    plans = note_scan.note_plans(noted_blocks(spark, sf_dir))
    return plans.withColumn("text", F.sha2(F.col("text").cast("binary"), 256)).withColumnRenamed("text", "text_sha256")


@query("note_annotations")
def note_annotations(spark, sf_dir):
    """Texts with their references to notes as placeholders."""
    blocks = components.kept(noted_blocks(spark, sf_dir))
    texts, _ = note_scan.annotated(blocks, note_scan.note_plans(blocks))
    return texts.select("book", "page", "place", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("note_reference_links")
def note_reference_links(spark, sf_dir):
    """Each reference with its note."""
    blocks = components.kept(noted_blocks(spark, sf_dir))
    return note_scan.annotated(blocks, note_scan.note_plans(blocks))[1].drop("nth")


#: Pages in languages of their own flow past one another: a page goes on at the next of its language, whatever lies between.
FLOW_SQL = BOOK.replace("lang, text, CAST", "lang, CASE doc_id % 4 WHEN 0 THEN left(text, 60) || 'ab-' WHEN 1 THEN 'cd' || text WHEN 2 THEN 'ef' || left(text, 40) || '-' ELSE left(text, 30) END AS text, CAST") + """,
n AS (SELECT doc_id, source, text, lead(doc_id) OVER w AS b, lead(text) OVER w AS after FROM book WINDOW w AS (PARTITION BY source, lang ORDER BY page)),
e AS (SELECT doc_id AS a, b, CASE WHEN regexp_matches(text, '-\\s*$') THEN CASE WHEN regexp_matches(after, '^\\s*\\p{Ll}') THEN 'remove_layout_hyphen' ELSE 'preserve_lexical_hyphen' END ELSE 'insert_space' END AS op FROM n
  WHERE b IS NOT NULL AND NOT regexp_matches(text, '[.!?]\\s*$') AND doc_id % 13 <> 7),
d AS (SELECT book.doc_id, e.a IS NULL AS opens, source, lang, page, text, op FROM book LEFT JOIN e ON e.b = book.doc_id), i AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY source, lang ORDER BY page) AS g FROM d)"""


def flow(spark, sf_dir):
    """(fragments, boundaries) of pages that go on at the next page of their language; every thirteenth boundary is vetoed."""
    n, t = F.col("doc_id"), F.col("text")
    text = F.when(n % 4 == 0, F.concat(F.left(t, F.lit(60)), F.lit("ab-"))).when(n % 4 == 1, F.concat(F.lit("cd"), t)).when(n % 4 == 2, F.concat(F.lit("ef"), F.left(t, F.lit(40)), F.lit("-"))).otherwise(F.left(t, F.lit(30)))
    docs = texts(spark, sf_dir).withColumn("text", text)
    ends = {"hyphen": F.col("text").rlike(r"-\s*$"), "done": F.col("text").rlike(r"[.!?]\s*$"), "small": F.col("text").rlike(r"^\s*\p{Ll}")}
    rows = book.numbered_pages(docs.select("doc_id", F.concat_ws("\x01", "source", "lang").alias("source"), *(c.alias(k) for k, c in ends.items())))
    pairs = book.beside(rows, "doc_id", "small").where("next.doc_id is not null")
    operation = F.when(F.col("hyphen"), F.when(F.col("next.small"), "remove_layout_hyphen").otherwise("preserve_lexical_hyphen")).otherwise("insert_space")
    boundaries = pairs.select(n.alias("a"), F.col("next.doc_id").alias("b"), operation.alias("operation"), (~F.col("done")).alias("join"), (n % 13 == 7).alias("veto"))
    return docs.select(n.alias("node"), n.alias("rank"), "text"), boundaries


@query("fragment_components", FLOW_SQL + " SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY source, lang, g) AS component FROM i")
def fragment_components(spark, sf_dir):
    """Each fragment with the first of those that boundaries connect it to."""
    fragments, boundaries = flow(spark, sf_dir)
    return components.components(fragments.select("node"), boundaries.where("join and not veto").select("a", "b"))


@query("reconstructed_blocks", FLOW_SQL + """, l AS (SELECT min(doc_id) AS first, list({'op': op, 't': text} ORDER BY page) AS l FROM i GROUP BY source, lang, g), r AS (SELECT first, l, list_reduce(l, lambda a, x: {'op': x.op, 't': CASE x.op
  WHEN 'remove_layout_hyphen' THEN regexp_replace(a.t, '-\\s*$', '') || regexp_replace(x.t, '^\\s+', '') WHEN 'preserve_lexical_hyphen' THEN regexp_replace(a.t, '\\s+$', '') || regexp_replace(x.t, '^\\s+', '') ELSE regexp_replace(a.t, '\\s+$', '') || ' ' || regexp_replace(x.t, '^\\s+', '') END}).t AS t FROM l)
SELECT first, len(l)::INTEGER AS fragments, array_to_string(list_transform(l[2:], lambda x: x.op), ',') AS operations, sha256(t) AS text_sha256 FROM r""")
def reconstructed_blocks(spark, sf_dir):
    """Blocks of text that run on past pages of other languages, each boundary joined in its own way."""
    out = components.reconstructed(*flow(spark, sf_dir))
    return out.select("first", "fragments", "operations", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def marked_pages(spark, sf_dir):
    """Pages as text with bars for their markup and note placeholders behind some sentences."""
    barred = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "|")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(barred, r"([.!?]) ([A-M])", "$1{{NOTE_REF:1:r1}} $2").alias("text"))


NOTED_SQL = "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '|', 'g'), '([.!?]) ([A-M])', '\\1{{NOTE_REF:1:r1}} \\2', 'g') AS t FROM pages)"


@query("note_contracts", NOTED_SQL + """, c AS (SELECT page_id, regexp_extract_all(t, '\\{\\{NOTE_REF:[^:}]+:[^}]+\\}\\}') AS m, regexp_split_to_array(t, '\\{\\{NOTE_REF:[^:}]+:[^}]+\\}\\}') AS s FROM p)
SELECT page_id, len(m)::INTEGER AS markers, len(s)::INTEGER AS segments, CASE WHEN page_id % 4 <> 3 THEN sha256(array_to_string(list_transform(s, lambda x, i: 'T' || x || coalesce(m[i], '')), '')) END AS rebuilt_sha256 FROM c WHERE len(m) > 0""")
def note_contracts(spark, sf_dir):
    """Texts cut at their note placeholders, translated and put together; replies that lack a segment are refused."""
    c = F.col("c")
    rows = marked_pages(spark, sf_dir).select("page_id", contracts.note_contract(F.col("text")).alias("c")).where("c is not null")
    given = F.transform(c["segments"], lambda x: F.concat(F.lit("T"), x))
    reply = F.when(F.col("page_id") % 4 == 3, F.slice(given, F.lit(2), F.size(given))).otherwise(given)
    return rows.select("page_id", F.size("c.markers").alias("markers"), F.size("c.segments").alias("segments"), F.sha2(contracts.with_notes(c, reply).cast("binary"), 256).alias("rebuilt_sha256"))


def table_replies(template):
    """Replies to a page's segments: as asked, with one missing, one given twice, a foreign one, or a placeholder too many."""
    asked = contracts.segments(template)
    reply = lambda i, t: F.struct(i.alias("id"), t.alias("text"))
    good = F.transform(asked, lambda s: reply(s["id"], F.concat(F.lit(" t"), s["text"], F.lit(" "))))
    odd, n = F.col("page_id") % 6, F.size(good)
    return (
        F.when(odd == 1, F.slice(good, F.lit(2), n)).when(odd == 2, F.concat(good, F.array(reply(F.lit(0), F.lit("again"))))).when(odd == 3, F.concat(good, F.array(reply(n, F.lit("foreign")))))
        .when(odd == 4, F.concat(F.slice(good, F.lit(2), n), F.array(reply(F.lit(0), F.lit("x {{NOTE_REF:9:z}}"))))).otherwise(good)
    )


@query("table_contracts")
def table_contracts(spark, sf_dir):
    """Tables cut into literals and segments, and what replies make of them."""
    rows = marked_pages(spark, sf_dir).select("page_id", contracts.table_contract(F.col("text")).alias("t")).where("t is not null")
    out = rows.select("page_id", F.size("t").alias("tokens"), F.size(contracts.segments(F.col("t"))).alias("segments"), contracts.with_segments(F.col("t"), table_replies(F.col("t"))).alias("r"))
    return out.select("page_id", "tokens", "segments", F.sha2(F.col("r.text").cast("binary"), 256).alias("rebuilt_sha256"), "r.error")
