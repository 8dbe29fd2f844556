"""Rules on small texts that the tables do not hold, against Python's own reading of them."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import folds, similarity
from quire.functions import text as T


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def pair(spark, expression, values):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r.y for r in rows.select("i", expression(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()]


QUALITY = {
    "": ["empty_text", "low_printable_ratio"], None: ["empty_text", "low_printable_ratio"], "abc" * 3 + " " + "bc " * 12: [], "x y": ["too_few_characters"], "ab " * 13: ["too_few_characters"], "ab " * 14: [],
    "�" + "ab " * 130: ["unicode_replacement_characters"], "�" + "ab " * 170: [], "\x07" + "word " * 50: ["control_characters"], "word " * 20 + "z" * 8: ["repeated_characters"],
    "ab " * 20 + "abcdefghi" * 21: ["missing_spaces_or_font_mapping"], "many words in lines of hy-\nphened prose that goes on": ["hyphenation_reflow_required"],
    "!? " * 30: ["glyph_mapping_or_language_mismatch"], "same line of text\n" * 6: ["repeated_lines"],
}


def test_quality(spark):
    got = column(spark, T.page_quality, QUALITY)
    assert [list(g.issue_codes) for g in got] == list(QUALITY.values())
    by_text = dict(zip(QUALITY, got))
    assert by_text[""].quality_score == 0 and by_text[""].recommended_route == "ocr_router" and by_text["ab " * 14].passed
    assert by_text["x y"].quality_score == 0.55 and not by_text["x y"].passed


def test_quality_of_layout(spark):
    rows = spark.createDataFrame([("word " * 20, 2, 0.9), ("word " * 40, 1, 0.9)], "t string, c int, v double")
    got = [list(r.q.issue_codes) for r in rows.select(T.page_quality(F.col("t"), F.col("c"), F.col("v")).alias("q")).collect()]
    assert got == [["multi_column_reading_order_risk", "visual_coverage_text_mismatch"], []]


def test_language(spark):
    texts = ["これはペンです", "这" * 30, "the cat and the dog is in", "le chat et la souris", "der Hund und das Haus ist", "el perro y la casa que una", "xyz", "", None]
    assert column(spark, T.detect_language, texts) == ["ja", "zh-Hans", "en", "fr", "de", "es", "en", "en", "en"]


def test_edges(spark):
    pairs = [("it ends.", "Next"), ("it goes", "on here"), ("it goes", "On"), ("a word-", "Part"), ("open,", "The"), ("closed:", "x"), ("", "x"), ('He said "no."', "then"), ("end", ", more"), ("page", "12 more")]
    assert pair(spark, T.edge_relation, pairs) == ["no_join", "continue", "unresolved", "unresolved", "unresolved", "continue", "continue", "no_join", "continue", "continue"]
    assert pair(spark, T.continues_across_page, pairs) == [False, True, True, True, True, False, False, True, True, True]
    assert pair(spark, lambda a, b: T.edge_relation(a, F.lit(None).cast("string")), [("open", ""), ("done.", "")]) == ["unresolved", "no_join"]
    assert pair(spark, T.within_page_continuation, [("a,", "B"), ("a.", "b"), ("a", "b"), ("a", '"B'), ("a", "B")]) == [True, False, True, True, False]


def test_joins(spark):
    join = lambda op: lambda a, b: T.apply_join(a, b, F.lit(op))
    assert pair(spark, join("insert_space"), [("one ", " two")]) == ["one two"]
    assert pair(spark, join("remove_layout_hyphen"), [("hy-", "phen"), ("none", "here")]) == ["hyphen", None]
    assert pair(spark, join("preserve_lexical_hyphen"), [("well-", "known")]) == ["well-known"]
    assert pair(spark, join("other"), [("a", "b")]) == [None]


def test_labels_and_names(spark):
    assert pair(spark, lambda a, b: T.page_label(a, F.lit(7)), [("xii", ""), ("【12】", ""), ("page", ""), (None, ""), ("3.", "")]) == ["xii", "12", "7", "7", "3"]
    assert column(spark, T.safe_filename, ["a/b:c", "con", " .. ", "x" * 200]) == ["a b c", "_con", "Book", "x" * 120]
    assert column(spark, T.redacted, ["api_key = abc", "Authorization: Bearer xyz", "plain"]) == ["api_key = [REDACTED]", "Authorization: [REDACTED] [REDACTED]", "plain"]
    assert column(spark, T.title_key, ["Æsop's Tale!"]) == ["aesopstale"]
    assert column(spark, T.protected_literals, ["see https://a.b/c). and me@x.org, 10.1234/ab; https://a.b/c"]) == [["https://a.b/c", "me@x.org", "10.1234/ab"]]
    assert column(spark, T.is_chapter_heading, ["Chapter IV", "CHAPTER 12 On", "Chapterhouse", "第三章"]) == [True, True, False, True]


def test_numerals(spark):
    assert column(spark, T.chinese_number, [0, 9, 10, 11, 20, 35, 99], "int") == ["零", "九", "十", "十一", "二十", "三十五", "九十九"]
    assert column(spark, T.roman_number, [1, 4, 9, 14, 1994, 2026], "int") == ["I", "IV", "IX", "XIV", "MCMXCIV", "MMXXVI"]


def test_chunks(spark):
    texts = ["", "a\nb", "x" * 25, "one two\nthree four five\n\nsix", "abcdefghij\nk\nlmnopqrs", "ab" * 30 + "\nc"]
    assert column(spark, lambda c: T.chunks(c, 10), texts) == [
        [], ["a\nb"], ["x" * 10, "x" * 10, "x" * 5], ["one two", "three four", "five\nsix"], ["abcdefghij", "k\nlmnopqrs"], ["ababababab"] * 6 + ["c"],
    ]


def test_reflow(spark):
    text = "CHAPTER ONE\nThis is a para-\ngraph that\nruns on.\n\n- first item\n- second item\nafter it\nmore"
    assert column(spark, T.reflowed, [text]) == ["CHAPTER ONE\n\nThis is a paragraph that runs on.\n\n- first item\n\n- second item\n\nafter it more"]


def test_clusters(spark):
    values = [[3.0, 1.0, 6.0, 6.5, 20.0], [], [1.0, 5.0, 9.0]]
    assert column(spark, lambda c: folds.clusters_from_first(c, 5.0), values, "array<double>") == [[[1.0, 3.0, 6.0], [6.5], [20.0]], [], [[1.0, 5.0], [9.0]]]
    assert column(spark, lambda c: folds.clusters_from_mean(c, 4.5), values, "array<double>") == [[4, 1], [], [2, 1]]


def test_placeholders(spark):
    text = "go to www.a.org now, www.a.org again or mail x@y.zz"
    got = column(spark, folds.protected, [text, "none"])
    assert got[0].text == "go to __QUIRE_PH_0000__ now, __QUIRE_PH_0001__ again or mail __QUIRE_PH_0002__" and got[1].text == "none"
    rows = spark.createDataFrame([(got[0].text, got[0].terms), (got[0].text.replace("__QUIRE_PH_0001__", ""), got[0].terms)], "t string, m array<string>")
    assert [r.y for r in rows.select(folds.restored(F.col("t"), F.col("m")).alias("y")).collect()] == [text, None]


def test_tables(spark):
    assert column(spark, folds.table_cells, ["| a | b |", "c|d|e"]) == [["a", "b"], ["c", "d", "e"]]
    assert column(spark, folds.rectangular, [[["a"], ["b", "c"]]], "array<array<string>>") == [[["a", ""], ["b", "c"]]]


def test_sections_and_index(spark):
    kinds = [["blank", "chapter", "body", "blank", "body", "appendix", "appendix", "chapter", "chapter"]]
    assert column(spark, folds.section_types, kinds, "array<string>") == [[1, 2, 2, 2, 2, 3, 3, 4, 5]]
    assert column(spark, folds.index_parents, [[0, 1, 2, 1, 2, 0, 2]], "array<int>") == [[0, 1, 2, 1, 4, 0, 0]]


def test_similarity(spark):
    pairs = [("The Cat sat", "the cat sits"), ("abc", "xyz"), ("", ""), (None, "a")]
    bare = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    want = [None if a is None else SequenceMatcher(None, bare(a), bare(b), False).ratio() for a, b in pairs]
    assert pair(spark, similarity.similarity, pairs) == [pytest.approx(w) if w is not None else None for w in want]


def test_fidelity(spark):
    rows = [("same text", "Same  text", "en", "de"), ("same text", "same text", "en", "en"), ("a long enough english sentence", "no letters of it", "en", "ja"), ("这" * 12, "这" * 8 + " x", "zh-Hans", "en"), ("a", "a", "en", "fr")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string")
    got = [r.y for r in df.select("i", similarity.fidelity(*(F.col(c) for c in "abcd")).alias("y")).orderBy("i").collect()]
    assert got == ["source_echo", None, "target_script_absent", "source_script_leak", None]


def test_token_differences(spark):
    """As the reference finds them: all numbers, thirty capitalised words."""
    a = " ".join(f"{n}.5" for n in range(40)) + " 3.14 1,000,5 x7 " + " ".join(f"Wo{chr(97 + n // 26)}{chr(97 + n % 26)}rd" for n in range(40)) + " O'Neil Ab Élan"
    b = "3 14 0.5 Woaard"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.numbers_only_in(F.col("a"), F.col("b")), T.capitalised_only_in(F.col("a"), F.col("b")), T.numbers_only_in(F.col("b"), F.col("a"))).first()
    found = lambda pattern, x, y: sorted(set(re.findall(pattern, x)) - set(re.findall(pattern, y)))
    numbers, words = r"\b\d+(?:[.,]\d+)*\b", r"\b[A-Z][A-Za-z'-]{2,}\b"
    assert tuple(row) == (found(numbers, a, b), found(words, a, b)[:30], found(numbers, b, a)) and len(row[0]) == 41


def test_integrity_warnings_know_ascii_words_beside_other_letters(spark):
    """As the SQL's engine does: a letter with an accent ends a word."""
    rows = [("osñ no", "x"), ("asñno lo", "x"), ("noé", "x"), ("knot", "x"), ("é12 13é 4a", "x"), ("é12,5 no", "12 不"), ("١٢", "x")]
    out = spark.createDataFrame(rows, "s string, t string").select("s", F.array_join(T.integrity_warnings(F.col("s"), F.col("t")), " ").alias("w"))
    none, number = "possible_missing_negation", "possible_missing_number:"
    assert {r.s: r.w for r in out.collect()} == {"osñ no": none, "asñno lo": none, "noé": none, "knot": "", "é12 13é 4a": f"{number}12 {number}13", "é12,5 no": f"{number}12,5", "١٢": ""}


def test_line_quality_is_that_of_page_quality(spark, sf_dir):
    """The same figures, white space at the ends as Python has it, without the passes over a text that tell of other things."""
    from quire.plans import planted

    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = [*QUALITY, f"{spaces}x{spaces}y{spaces}", "a\x0c b \x0ca\x85  c-\n d", spaces]
    full, own = column(spark, T.page_quality, texts), column(spark, T.line_quality, texts)
    assert [(o.duplicate_line_ratio, o.hyphenated_line_breaks) for o in own] == [(f.duplicate_line_ratio, f.hyphenated_line_breaks) for f in full]
    rows = [[x for line in re.split("[\n\x0b\x0c\x1c-\x1e\x85  ]", (t or "").replace("\r\n", "\n").replace("\r", "\n")) if (x := line.strip())] for t in texts]
    assert [o.lines for o in own] == list(map(len, rows))
    assert column(spark, T.strip, texts) == [t if t is None else t.strip() for t in texts]
    assert r"\p{Cc}" not in planted.form_feed_quality(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
