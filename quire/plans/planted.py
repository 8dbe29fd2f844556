"""Rules whose cases the driver's tables lack, on rows planted for them: a case of each kind is dealt to every document.

Where SQL has no words for a rule, the value expected of each planted case stands in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import folds, notes, similarity
from quire.functions import roles as R
from quire.functions import text as T
from quire.operators import book
from quire.plans.catalog import BARE, LINES, NEXT, QUALITY, RELATION, query, table, texts
from quire.plans.roles import _dealt, _list, dealt


def _quoted(values: list) -> str:
    """A list of SQL strings, control characters by their codes."""
    plain = lambda v: "NULL" if v is None else " || ".join(f"chr({ord(c)})" if ord(c) < 32 else f"'{c}'" for c in v).replace("' || '", "").replace("'''", "''''") or "''"
    return "[" + ", ".join(plain(v) for v in values) + "]"


def _picked(values: list, n: str = "doc_id") -> str:
    return f"{_quoted(values)}[({n}) % {len(values)} + 1]"


ENDS = "".join(f"chr({n})||" for n in (11, 12, 28, 29, 30, 133, 8232, 8233)).rstrip("|")
ANY_LINES = LINES.replace("string_split(text, chr(10))", f"string_split(translate(text, {ENDS}, repeat(chr(10), 8)), chr(10))")


HYPHENED = NEXT.replace("lang, text, CAST", "lang, CASE doc_id % 4 WHEN 0 THEN left(text, 60) || 'ab-' WHEN 1 THEN 'cd' || text WHEN 2 THEN 'Ef' || left(text, 40) || '-' ELSE text END AS text, CAST")


def hyphened():
    n, t = F.pmod("doc_id", F.lit(4)), F.col("text")
    return F.when(n == 0, F.concat(F.left(t, F.lit(60)), F.lit("ab-"))).when(n == 1, F.concat(F.lit("cd"), t)).when(n == 2, F.concat(F.lit("Ef"), F.left(t, F.lit(40)), F.lit("-"))).otherwise(t)


@query("form_feed_quality", QUALITY.replace(LINES, ANY_LINES).replace("lang, text, CAST", "lang, replace(text, 'e', chr(12)) AS text, CAST") + " SELECT source, page, len(l)::INTEGER AS lines, dup AS duplicate_line_ratio, hyphens::INTEGER AS hyphenated_line_breaks FROM r")
def form_feed_quality(spark, sf_dir):
    """Quality of pages whose lines end in form feeds, as text from page images does."""
    docs = texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("e"), F.lit("\x0c")))
    made = docs.select("source", "doc_id", T.line_quality(F.col("text")).alias("q"), F.col("text").isNotNull().alias("given"))
    return book.numbered_pages(made).select("source", "page", F.when(F.col("given"), F.col("q.lines")).alias("lines"), "q.duplicate_line_ratio", "q.hyphenated_line_breaks")


@query("joined_blocks", HYPHENED + f""", s AS (SELECT source, page, {BARE} AS bare, CASE WHEN before IS NOT NULL AND {RELATION.format('before', 'text')} = 'continue' THEN 0 ELSE 1 END AS st FROM n),
i AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY page) AS island FROM s), g AS (SELECT source, min(page) AS first_page, count(*) AS fragments, list(bare ORDER BY page) AS l FROM i GROUP BY source, island),
j AS (SELECT *, list_reduce(l, lambda a, x: CASE WHEN a = '' THEN x WHEN x = '' THEN a WHEN a LIKE '%-' AND regexp_matches(x, '^\\p{{Ll}}') THEN left(a, length(a) - 1) || x WHEN a LIKE '%-' THEN a || x ELSE a || ' ' || x END) AS t FROM g)
SELECT source, first_page, fragments, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS text_sha256 FROM j""")
def joined_blocks(spark, sf_dir):
    """Blocks over page edges that break words: every third page is cut behind a hyphen planted in it, half of the pages start small."""
    return book.joined_blocks(texts(spark, sf_dir).withColumn("text", hyphened()))


SCRIPTS = {
    "これは本です": "ja", "這是一本關於旅行的舊書內容包括山川河流城市鄉村人物風俗" : "zh-Hans", "短い Kana カ": "ja", "一二三 is not enough of it": "en", "le la les et des": "fr", "xyz": "en", "und der die das ist": "de", "": "en",
}


@query("script_detection", f"SELECT doc_id, {_dealt(list(SCRIPTS.values()), 'doc_id')} AS detected FROM documents")
def script_detection(spark, sf_dir):
    """Kana first, then enough of Chinese, then words, else English."""
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(dealt(list(SCRIPTS), F.col("doc_id"))).alias("detected"))


HAN = "這是一本關於旅行的舊書"
LATIN = "the quick brown fox jumps over the lazy dog"
#: (source, target, source language, target language, terms, violation)
TRANSLATIONS = [
    (LATIN, LATIN, "en", "fr", [], "source_echo"), (LATIN, LATIN.upper(), "en", "de", [], "source_echo"), ("Yangtze", "Yangtze", "en", "de", ["yangtze"], None), ("abc", "abc", "en", "fr", [], None),
    (HAN, "x " + HAN, "zh-Hans", "en", [], "source_script_leak"), (HAN, "a book of travels", "zh-Hans", "en", [], None), (LATIN, "nothing in the right script", "en", "ja", [], "target_script_absent"), (LATIN, HAN, "en", "zh-Hans", [], None),
    ("by Fox through snow", "par Fox", "en", "fr", ["Fox"], None), ("by Fox through snow", "par fox", "en", "fr", ["Fox"], "protected_term_changed"), ("by Foxes here", "rien", "en", "fr", ["Fox"], None), ("by Fox through snow", "les Foxs", "en", "fr", ["Fox"], None),
    (LATIN, LATIN, "en", "en", [], None), ("a ｆｕｌｌ width line", "a full width line", "en", "es", [], "source_echo"), ("x {{NOTE_REF:1:n}} yz", "x yz", "en", "es", [], "source_echo"), ("A+B of it", "A+Bs", "en", "de", ["A+B"], None),
]


@query("fidelity_rules", f"SELECT doc_id, {_dealt([t[5] for t in TRANSLATIONS], 'doc_id')} AS violation FROM documents")
def fidelity_rules(spark, sf_dir):
    """What is wrong with a translation: echoes, protected terms, leaked and absent scripts."""
    cases = F.array(*(F.struct(*map(F.lit, t[:4]), F.array(*map(F.lit, t[4])).cast("array<string>").alias("terms")) for t in TRANSLATIONS))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(cases, (F.pmod("doc_id", F.lit(len(TRANSLATIONS))) + 1).cast("int")).alias("t"))
    rows = rows.select("doc_id", F.col("t.col1").alias("a"), F.col("t.col2").alias("b"), F.col("t.col3").alias("x"), F.col("t.col4").alias("y"), "t.terms")
    return rows.select("doc_id", similarity.fidelity(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("terms")).alias("violation"))


@query("integrity_warnings", r"""WITH t AS (SELECT a.doc_id, a.text AS s, CASE WHEN a.doc_id % 3 = 0 THEN '不' ELSE '' END || b.text AS t FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
w AS (SELECT doc_id, s, t, list_filter(list_sort(list_distinct(regexp_extract_all(s, '\b\d+(?:[.,]\d+)?\b'))), lambda v: NOT contains(t, v)) AS n FROM t)
SELECT doc_id, array_to_string(list_transform(n, lambda v: 'possible_missing_number:' || v) || CASE WHEN regexp_matches(s, '(?i)\b(?:not|never|no|without|cannot|could not|would not)\b') AND NOT regexp_matches(t, '不|未|无|没有|非|勿') THEN ['possible_missing_negation'] ELSE [] END, ' ') AS warnings FROM w""")
def integrity_warnings(spark, sf_dir):
    """Numbers and negations that the next text, taken for a translation, lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    other = F.concat(F.when(F.col("doc_id") % 3 == 0, "不").otherwise(""), "other")
    return both.select("doc_id", F.array_join(T.integrity_warnings(F.col("text"), other), " ").alias("warnings"))


PARTS = ["it runs on ", "a word bro-", "a well-", "", "He stopped. ", "“quoted,” ", "and then—"]
NEXT_PARTS = [" and on", "ken here", "known man", "Upper", "“Again", "lower case", ", so"]
OPERATIONS = ["insert_space", "remove_layout_hyphen", "preserve_lexical_hyphen", "other"]


@query("join_operations", f"""WITH p AS (SELECT doc_id, regexp_replace({_picked(PARTS)}, '\\s+$', '') AS a, regexp_replace({_picked(NEXT_PARTS, 'doc_id // 7')}, '^\\s+', '') AS b, {_dealt(OPERATIONS, 'doc_id // 49')} AS op FROM documents)
SELECT doc_id, CASE op WHEN 'insert_space' THEN a || ' ' || b WHEN 'remove_layout_hyphen' THEN CASE WHEN a LIKE '%-' THEN left(a, length(a) - 1) || b END WHEN 'preserve_lexical_hyphen' THEN a || b END AS joined FROM p""")
def join_operations(spark, sf_dir):
    """Two fragments as one by the operation of their boundary."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.apply_join(dealt(PARTS, n), dealt(NEXT_PARTS, F.floor(n / 7)), dealt(OPERATIONS, F.floor(n / 49))).alias("joined"))


@query("within_page", f"""WITH p AS (SELECT doc_id, regexp_replace({_picked(PARTS)}, '\\s+$', '') AS a, {_picked(NEXT_PARTS, 'doc_id // 7')} AS b FROM documents), e AS (SELECT *, regexp_replace(regexp_replace(a, '["\\x27”’)\\]}}]+$', ''), '\\s+$', '') AS ending FROM p)
SELECT doc_id, NOT regexp_matches(ending, '[.!?…]$') AND ending <> '' AND (regexp_matches(ending, '[,;:—–-]$') OR regexp_matches(regexp_extract(b, '[A-Za-z]'), '^[a-z]$') OR regexp_matches(regexp_replace(b, '^\\s+', ''), '^["\\x27“‘]')) AS continues FROM e""")
def within_page(spark, sf_dir):
    """Whether a block goes on in the next one of its page."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.within_page_continuation(dealt(PARTS, n), dealt(NEXT_PARTS, F.floor(n / 7))).alias("continues"))


LABELS = {"12": "12", "【 xiv 】": "xiv", "iv.": "iv", "abc": None, "12345": None, " 7! ": "7", "": None}


@query("page_labels", f"SELECT doc_id, coalesce({_dealt(list(LABELS.values()), 'doc_id')}, doc_id::VARCHAR) AS label FROM documents")
def page_labels(spark, sf_dir):
    """The printed number of a page, or its physical one."""
    return table(spark, sf_dir, "documents").select("doc_id", T.page_label(dealt(list(LABELS), F.col("doc_id")), F.col("doc_id")).alias("label"))


TENS = lambda one, five, ten: [one * n if n < 4 else one + five if n == 4 else five + one * (n - 5) if n < 9 else one + ten for n in range(10)]


@query("roman_numbers", f"""WITH n AS (SELECT o_orderkey, CAST(o_orderkey % 3999 + 1 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, repeat('M', n // 1000) || {_list(TENS('C', 'D', 'M'))}[n // 100 % 10 + 1] || {_list(TENS('X', 'L', 'C'))}[n // 10 % 10 + 1] || {_list(TENS('I', 'V', 'X'))}[n % 10 + 1] AS roman FROM n""")
def roman_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.roman_number(F.col("o_orderkey") % 3999 + 1).alias("roman"))


@query("chinese_numbers", """WITH n AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS INTEGER) AS n FROM lineitem), d AS (SELECT *, ['零','一','二','三','四','五','六','七','八','九'] AS c FROM n)
SELECT l_orderkey, l_linenumber, CASE WHEN n < 10 THEN c[n + 1] ELSE CASE WHEN n >= 20 THEN c[n // 10 + 1] ELSE '' END || '十' || CASE WHEN n % 10 > 0 THEN c[n % 10 + 1] ELSE '' END END AS chinese FROM d""")
def chinese_numbers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.chinese_number(F.col("l_partkey") % 100).alias("chinese"))


MEASURES = {"12 ft. and 3 in. or 2 miles": "ft. | in. | miles", "no measure": None, "10 LB of it": "LB", "£5 6s. 3d.": None, "forty li": "li", "5 mm, 6 feet": "mm | feet"}


@query("raw_units", f"SELECT doc_id, {_picked([v.replace('ft. |', 'ft |').replace('in. |', 'in |') if v else v for v in MEASURES.values()])} AS units FROM documents")
def raw_units(spark, sf_dir):
    """Units of measure as they stand: a closing point counts only before a letter or figure."""
    return table(spark, sf_dir, "documents").select("doc_id", T.raw_units(dealt(list(MEASURES), F.col("doc_id"))).alias("units"))


MARKDOWN = {
    "<!-- page 1 -->\nTitle\nbody  \n": "<!-- page 1 -->\n# Title\nbody", "<!-- page 2 -->\n\n# Has one\n1.2 Part of it": "<!-- page 2 -->\n\n# Has one\n## 1.2 Part of it",
    "1.2.3 Deep\n#1.2 kept": "### 1.2.3 Deep\n#1.2 kept", "3 no place\n  indented": "3 no place\n  indented", "": "",
}


@query("page_markdown", f"SELECT doc_id, {_picked(list(MARKDOWN.values()))} AS markdown FROM documents")
def page_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.page_markdown(dealt(list(MARKDOWN), F.col("doc_id"))).alias("markdown"))


#: (label, the number before, as it is read)
NOTE_LABELS = [("l2", 11, "12"), ("12", 3, "12"), ("iv", 3, "4"), ("ii", 10, "11"), ("ii", 1, "2"), ("ix", None, "9"), ("lo", None, "10"), ("x*", 4, "x*"), ("o", None, "0"), ("mcm", 5, "1900"), ("l", 49, "50"), ("l", 0, "1")]


@query("note_label_repair", f"SELECT doc_id, {_picked([x[2] for x in NOTE_LABELS])} AS label FROM documents")
def note_label_repair(spark, sf_dir):
    """Note labels misread as letters, or in Roman figures, by the number before."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", notes.note_label(dealt([x[0] for x in NOTE_LABELS], n), dealt([x[1] for x in NOTE_LABELS], n)).alias("label"))


PRINTED = {"[12]": 12, "— 7 —": None, "(3)": 3, "iv": None, "- 45 -": 45, "【9】": 9, "": None}


@query("printed_numbers", f"SELECT doc_id, {list(PRINTED.values())}[doc_id % {len(PRINTED)} + 1]::INTEGER AS number FROM documents".replace("None", "NULL"))
def printed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", notes.printed_number(dealt(list(PRINTED), F.col("doc_id"))).alias("number"))


TRUTHS = ["1", " Yes ", "no", "TRUE", "y", "0", None, "on"]


@query("truth_values", f"SELECT doc_id, coalesce(lower(trim({_picked(TRUTHS)})) IN ('1', 'true', 'yes', 'y'), false) AS truth FROM documents")
def truth_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", notes.truthy(dealt(TRUTHS, F.col("doc_id"))).alias("truth"))


FENCES = {"```json\n{\"a\": 1}\n```": "{\"a\": 1}", "{\"b\": 2}": "{\"b\": 2}", "```\nx\n```  ": "x", "```json\nbroken": None, "  plain ": "plain"}


@query("fenced_replies", f"SELECT doc_id, {_picked(list(FENCES.values()))} AS body FROM documents")
def fenced_replies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", notes.fence_body(dealt(list(FENCES), F.col("doc_id"))).alias("body"))


NOTE_SIDES = ["a {{NOTE_REF:1:r1}} b {{NOTE_REF:2:r2}}", "x {{NOTE_REF:2:r2}} {{NOTE_REF:1:r1}}", "{{NOTE_REF:1:r1}}{{NOTE_REF:2:r2}}", "none"]


@query("placeholder_order", rf"""WITH p AS (SELECT doc_id, regexp_extract_all({_picked(NOTE_SIDES)}, '\{{\{{NOTE_REF:[^:}}]+:[^}}]+\}}\}}') AS a, regexp_extract_all({_picked(NOTE_SIDES, 'doc_id // 4')}, '\{{\{{NOTE_REF:[^:}}]+:[^}}]+\}}\}}') AS b FROM documents) SELECT doc_id, a = b AS kept FROM p""")
def placeholder_order(spark, sf_dir):
    """Whether a translation keeps the note references of its source, in order."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", folds.same_placeholders(dealt(NOTE_SIDES, n), dealt(NOTE_SIDES, F.floor(n / 4))).alias("kept"))


SHORT_SOURCE = "A source of a few words that runs on for more than fifty characters in all"
#: (block type, returned type, source, translation, before, after, terms, verdict of the body rule)
UNITS = [
    ("body", "body", SHORT_SOURCE, "Une source de quelques mots", None, None, ["mots"], "accepted"), ("body", "caption", SHORT_SOURCE, "x", None, None, [], "block_type_mismatch"), ("body", "body", SHORT_SOURCE, "  ", None, None, [], "empty"),
    ("body", "body", SHORT_SOURCE, " what stood before ", "what stood before", None, [], "copied_context_before"), ("body", "body", SHORT_SOURCE, "what came after it", "", "what came after it ", [], "copied_context_after"),
    ("body", "body", SHORT_SOURCE, SHORT_SOURCE, None, None, [], "copied_source"), ("caption", "caption", SHORT_SOURCE, SHORT_SOURCE, None, None, [], "accepted"), ("body", "body", "four short words here", "four short words here", None, None, [], "accepted"),
    ("body", "body", SHORT_SOURCE, "court", None, None, [], "too_short"), ("caption", "caption", SHORT_SOURCE, "court", None, None, [], "accepted"), ("body", "body", SHORT_SOURCE, "assez long pour passer", None, None, ["a", " a "], "duplicate_terms"),
]


def _units(rows):
    cases = F.array(*(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(("block_type", "returned_type", "source", "translation", "before", "after"), u)), F.array(*map(F.lit, u[6])).cast("array<string>").alias("terms")) for u in UNITS))
    return rows.select("doc_id", F.element_at(cases, (F.pmod("doc_id", F.lit(len(UNITS))) + 1).cast("int")).alias("u"))


@query("body_acceptance", f"SELECT doc_id, {_dealt([u[7] for u in UNITS], 'doc_id')} AS verdict, {_picked([u[3] if set(map(str.strip, u[6])) <= {t for t in map(str.strip, u[6]) if t in u[3]} else u[3].rstrip() + '（原文保留：' + '；'.join(t.strip() for t in u[6] if t.strip() not in u[3]) + '）' for u in UNITS])} AS kept FROM documents")
def body_acceptance(spark, sf_dir):
    """Whether a translation of a block is taken, and the text with the terms it lost."""
    rows = _units(table(spark, sf_dir, "documents"))
    u = F.col("u")
    return rows.select("doc_id", notes.body_acceptance(u, u["translation"]).alias("verdict"), notes.with_preserved_terms(u["translation"], u["terms"]).alias("kept"))


#: (id, returned id, type, returned type, source, translation, before, after, verdict of the strict rule)
STRICT = [
    ("logical2_a", "logical2_a", "body", "body", SHORT_SOURCE, "Une source de quelques mots", None, None, "accepted"), ("logical2_a", "logical2_b", "body", "body", SHORT_SOURCE, "x", None, None, "id_mismatch"), ("logical2_a", "logical2_a", "body", "title", SHORT_SOURCE, "x", None, None, "block_type_mismatch"),
    ("logical2_a", "logical2_a", "body", "body", "the  source", "it has the source in it", None, None, "repeats_source"), ("logical2_a", "logical2_a", "body", "body", SHORT_SOURCE, "it holds what  stood before", "what stood before", None, "context_leakage"), ("logical2_a", "logical2_a", "body", "body", SHORT_SOURCE, "it holds the rest of it", "", "the rest", "context_leakage"),
    ("logical2_a", "logical2_a", "body", "body", SHORT_SOURCE, "see logical2_b of them", None, None, "unrelated_id"), ("logical2_a", "logical2_a", "body", "body", SHORT_SOURCE, "see logical2_a of them", None, None, "accepted"), ("logical2_a", "logical2_a", "body", "body", SHORT_SOURCE, "court", None, None, "too_short"),
    ("logical2_a", "logical2_a", "chapter_title", "chapter_title", SHORT_SOURCE, "court", None, None, "accepted"),
]


@query("strict_acceptance", f"SELECT doc_id, {_dealt([u[8] for u in STRICT], 'doc_id')} AS verdict FROM documents")
def strict_acceptance(spark, sf_dir):
    names = ("id", "returned_id", "block_type", "returned_type", "source", "translation", "before", "after")
    cases = F.array(*(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(names, u))) for u in STRICT))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(cases, (F.pmod("doc_id", F.lit(len(STRICT))) + 1).cast("int")).alias("u"))
    return rows.select("doc_id", notes.strict_acceptance(F.col("u"), F.col("u.translation"), R.TITLES).alias("verdict"))
