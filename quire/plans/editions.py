"""Queries on groups, providers, layouts, overlays and release checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import book, keys, providers
from quire.plans.catalog import BARE, BOOK, NEXT, RELATION, pages, query, table, texts


MOCK = "SELECT doc_id AS unit, sha256('[mock] ' || text) AS translated_sha256, NULL::VARCHAR AS error FROM documents"


@query("mock_translation", MOCK)
def mock_translation(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), providers.mock(F.col("text")).alias("translated"))
    return out.select("unit", keys.text_hash(F.col("translated")).alias("translated_sha256"), F.lit(None).cast("string").alias("error"))


@query("provider_translation", MOCK)
def provider_translation(spark, sf_dir):
    """The same by a provider in Python, which gets batches of texts."""
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text")
    out = providers.run_provider(units, lambda texts: [f"[mock] {t}" for t in texts])
    return out.select("unit", keys.text_hash(F.col("translated")).alias("translated_sha256"), "error")


@query("translation_groups", NEXT + f""", s AS (SELECT source, page, {BARE} AS bare, CASE WHEN before IS NOT NULL AND {RELATION.format('before', 'text')} = 'continue' THEN 0 ELSE 1 END AS st FROM n), i AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY page) AS g FROM s)
SELECT source, min(page) AS first_page, count(*) AS members, 'tug_' || substr(sha256(string_agg(source || ':' || page, '|' ORDER BY page)), 1, 24) AS group_id, sha256(string_agg(bare, chr(10) ORDER BY page)) AS text_sha256 FROM i GROUP BY source, g""")
def translation_groups(spark, sf_dir):
    rows = book.block_texts(texts(spark, sf_dir))
    member = F.array_sort(F.collect_list(F.struct("page", F.concat_ws(":", "source", F.col("page").cast("string")).alias("id"), T.strip(F.col("text")).alias("t"))))
    groups = rows.groupBy("source", "block").agg(F.min("page").alias("first_page"), F.count("*").alias("members"), member.alias("m"))
    group_id = F.concat(F.lit("tug_"), F.substring(keys.text_hash(F.array_join(F.col("m.id"), "|")), 1, 24))
    return groups.select("source", "first_page", "members", group_id.alias("group_id"), keys.text_hash(F.array_join(F.col("m.t"), "\n")).alias("text_sha256"))


@query("two_column_order", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity >= 25, l_extendedprice, l_linenumber, l_partkey) AS INTEGER) AS place FROM lineitem")
def two_column_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity") >= 25, "l_extendedprice", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"))


@query("overlay_fallback", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'hidden' WHEN l.quality = 0 THEN 'edited' ELSE d.lang END AS value, CASE WHEN l.toxic = 1 THEN 'second_overlay' WHEN l.quality = 0 THEN 'overlay' ELSE 'base' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay_fallback(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    one = l.where("quality = 0").select("doc_id", F.lit("edited").alias("one"))
    two = l.where("toxic = 1").select("doc_id", F.lit("hidden").alias("two"))
    origin = F.when(F.col("two").isNotNull(), "second_overlay").when(F.col("one").isNotNull(), "overlay").otherwise("base")
    return d.join(one, "doc_id", "left").join(two, "doc_id", "left").select("doc_id", F.coalesce("two", "one", "lang").alias("value"), origin.alias("origin"))


@query("composite_duplicates", "SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def composite_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1")


@query("appendix_coverage", BOOK + ", h AS (SELECT source, lang, list(DISTINCT page) AS have, min(page) AS a, max(page) AS b FROM book GROUP BY source, lang) SELECT source, lang, len(have)::INTEGER AS pages, (b - a + 1 - len(have))::INTEGER AS missing FROM h")
def appendix_coverage(spark, sf_dir):
    have = pages(spark, sf_dir).groupBy("source", "lang").agg(F.collect_set("page").alias("have"), F.min("page").alias("a"), F.max("page").alias("b"))
    return have.select("source", "lang", F.size("have").alias("pages"), F.size(F.array_except(F.sequence("a", "b"), "have")).alias("missing"))


@query("asset_dedupe", "SELECT sha256(text) AS asset, min(doc_id) OVER (PARTITION BY text) AS first_doc, doc_id AS linked FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1")
def asset_dedupe(spark, sf_dir):
    """A row for each page of an asset that several pages have, with the first of them: no list grows with its group."""
    rows = texts(spark, sf_dir).where("text is not null").select("doc_id", keys.text_hash(F.col("text")).alias("asset"))
    shared = rows.groupBy("asset").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, "asset").select("asset", "first_doc", F.col("doc_id").alias("linked"))


@query("role_distribution", "SELECT role, turn % 2 = 0 AS even_turn, count(*) AS n, min(length(text))::INTEGER AS shortest, max(length(text))::INTEGER AS longest FROM conversations GROUP BY ALL")
def role_distribution(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role", (F.col("turn") % 2 == 0).alias("even_turn")).agg(F.count("*").alias("n"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


@query("preflight_bounds", BOOK + " SELECT source, count(*) AS pages, count(*) * 3000 AS vision_low, count(*) * 8000 AS vision_high, (count(*) - 1) * 12000 AS pairs_high, sum(ceil(length(text) / 3500.0) * 1588)::BIGINT AS translation_tokens FROM book GROUP BY source")
def preflight_bounds(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("pages"), (n * 3000).alias("vision_low"), (n * 8000).alias("vision_high"), ((n - 1) * 12000).alias("pairs_high"), F.sum(F.ceil(F.length("text") / 3500) * 1588).alias("translation_tokens"))


@query("distinct_sizes", "SELECT DISTINCT round(l_quantity / 7, 2) AS width, round(l_discount, 2) AS height FROM lineitem")
def distinct_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.round(F.col("l_quantity") / 7, 2).alias("width"), F.round("l_discount", 2).alias("height")).distinct()


@query("command_availability", "SELECT o_orderkey, o_orderstatus = 'O' AS can_start, o_orderstatus = 'P' AS can_resume, o_orderstatus IN ('O', 'P') AS can_cancel, o_orderstatus = 'F' AS can_export, CASE o_orderstatus WHEN 'O' THEN 'idle' WHEN 'P' THEN 'attention' WHEN 'F' THEN 'done' ELSE 'warning' END AS presentation FROM orders")
def command_availability(spark, sf_dir):
    s = F.col("o_orderstatus")
    shown = F.create_map(F.lit("O"), F.lit("idle"), F.lit("P"), F.lit("attention"), F.lit("F"), F.lit("done"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (s == "O").alias("can_start"), (s == "P").alias("can_resume"), s.isin("O", "P").alias("can_cancel"), (s == "F").alias("can_export"), F.coalesce(shown[s], F.lit("warning")).alias("presentation"))


@query("release_eligibility", f"WITH b AS (SELECT source, count(*) FILTER (length({BARE}) = 0) AS blank, count(*) FILTER (n_chars <> length(text)) AS drifted, count(*) - count(DISTINCT doc_id) AS repeated FROM documents GROUP BY source) SELECT source, blank, drifted, repeated, blank + drifted + repeated = 0 AS eligible FROM b")
def release_eligibility(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(T.strip(F.col("text")) == "").alias("blank"), F.count_if(F.col("n_chars") != F.length("text")).alias("drifted"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"))
    return n.withColumn("eligible", F.col("blank") + F.col("drifted") + F.col("repeated") == 0)


@query("cross_references", "WITH t AS (SELECT DISTINCT lower(p_name) AS term FROM part), r AS (SELECT DISTINCT lower(p_type) AS ref FROM part) SELECT ref, EXISTS (SELECT 1 FROM t WHERE term = ref OR starts_with(term, ref || ' ')) AS resolved FROM r")
def cross_references(spark, sf_dir):
    """A reference resolves to a term that is it, or starts with it and a space: terms offer all their beginnings, an equi-join."""
    part = table(spark, sf_dir, "part")
    words = F.split(F.lower("p_name"), " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    terms = part.select(F.explode(starts).alias("ref")).distinct().withColumn("hit", F.lit(True))
    return part.select(F.lower("p_type").alias("ref")).distinct().join(terms, "ref", "left").select("ref", F.coalesce("hit", F.lit(False)).alias("resolved"))


@query("text_adjacency", BOOK + ", b AS (SELECT source, page, lead(page) OVER (PARTITION BY source ORDER BY page) AS next FROM book WHERE lang = 'en') SELECT source, page, next, next - page AS distance FROM b WHERE next - page > 1")
def text_adjacency(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("page")
    rows = pages(spark, sf_dir).where("lang = 'en'").select("source", "page", F.lead("page").over(w).alias("next"))
    return rows.where("next - page > 1").select("source", "page", "next", (F.col("next") - F.col("page")).alias("distance"))


@query("page_sets", "SELECT n_nationkey, (n_nationkey + 2) || '-' || (n_nationkey + 4) || ',1,' || (n_nationkey + 3) AS spec, array_to_string(list_sort(list_distinct([1, n_nationkey + 2, n_nationkey + 3, n_nationkey + 4])), ' ') AS pages FROM nation")
def page_sets(spark, sf_dir):
    k = F.col("n_nationkey")
    spec = F.concat((k + 2).cast("string"), F.lit("-"), (k + 4).cast("string"), F.lit(",1,"), (k + 3).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", spec.alias("spec"), F.array_join(T.page_set(spec).cast("array<string>"), " ").alias("pages"))


@query("rolled_scope", "SELECT r_name, n_name, count(*) AS jobs, round(sum(o_totalprice), 2) AS cost, grouping(n_name)::INTEGER AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rolled_scope(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.grouping("n_name").cast("int").alias("level"))
