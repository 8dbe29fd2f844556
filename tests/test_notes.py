from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import folds, notes
from quire.functions import text as T
from quire.operators import providers
from quire.sources import files


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_note_entries(spark):
    got = column(spark, notes.note_entries, ["Notes\n1. First note\nruns on\n2) Second", "no notes"])
    assert [tuple(e) for e in got[0]] == [(0, "Notes"), (1, "First note\nruns on"), (2, "Second")] and [tuple(e) for e in got[1]] == [(0, "no notes")]


def test_heading_scope(spark):
    heads = {"Notes": "document_endnote", " ENDNOTES ": "document_endnote", "Notes to  Chapter 4": "chapter_endnote", "Notas del capítulo 2": "chapter_endnote", "章末注": "chapter_endnote", "注": "document_endnote", "Noted": None, "Notes on it": None, "": None}
    assert column(spark, notes.heading_scope, list(heads)) == list(heads.values())
    assert column(spark, notes.major_heading, ["Chapter 4", "INDEX", "第三章", "Indexes", "A chapter", None]) == [True, True, True, False, False, False]


def test_numbered_entries(spark):
    texts = ["1. First\nruns on\n 2) Second", "before it\nl2. twelve", "none", "", None, "3. \n4. x"]
    got = column(spark, lambda c: notes.numbered_entries(c, F.lit(False)), texts)
    assert [e and [tuple(x) for x in e] for e in got] == [[("1", "First\nruns on"), ("2", "Second")], [(None, "before it"), ("l2", "twelve")], [(None, "none")], [], None, [("4", "x")]]
    got = column(spark, lambda c: notes.numbered_entries(c, F.lit(True)), ["* a star", "12 bare", "no mark", "1. one"])
    assert [[tuple(x) for x in e] for e in got] == [[("*", "a star")], [("12", "bare")], [(None, "no mark")], [("1", "one")]]


def test_index_entries(spark):
    got = column(spark, notes.index_entry, ["Athens, 12, 14-16", "Hellas. See Greece", "plain term"])
    assert [(e.term, list(e.refs), e.target) for e in got] == [("Athens", ["12", "14-16"], None), ("Hellas", [], "Greece"), ("plain term", [], None)]


def test_fences_and_groups(spark):
    assert column(spark, notes.fence_body, ['{"a":1}', '```json\n{"a":1}\n```', "```json\n{"]) == ['{"a":1}', '{"a":1}', None]
    rows = spark.createDataFrame([("one [[1]] two [[2]] three",), ("one [[2]] two [[1]] x",), ("one [[1]] two",), ("a [[1]] b [[2]] c [[2]]",)], "t string")
    parts = notes.group_parts(F.col("t"), F.array(F.lit("[[1]]"), F.lit("[[2]]")))
    assert [r.y for r in rows.select(parts.alias("y")).collect()] == [["one", "two", "three"], None, None, None]


def test_regions(spark):
    rows = [[("t", [0.1, 0.1, 0.5, 0.5], 1.7), ("u", [0.5, 0.1, 0.1, 0.5], 0.9), ("v", [0.1, 0.1], 0.9), ("w", [0.0, 0.0, 1.0, 1.0], None)]]
    got = column(spark, notes.normalised_regions, rows, "array<struct<type:string,bbox:array<double>,confidence:double>>")[0]
    assert [(r.type, r.confidence) for r in got.kept] == [("t", 1.0), ("w", 0.0)] and got.dropped == 2 and got.review


def test_wrapped_lines(spark):
    line = "array<struct<y0:double,y1:double,x0:double,font:double>>"
    rows = [[(0.1, 0.12, 0.1, 10.0), (0.13, 0.15, 0.11, 10.0), (0.3, 0.32, 0.1, 10.0), (0.33, 0.35, 0.1, 14.0)], []]
    assert column(spark, notes.wrapped_lines, rows, line) == [[2, 1, 1], []]


def test_paragraph_types(spark):
    rows = spark.createDataFrame([("A Running Head", True, False), ("Body ends here.", False, False), ("1. a note", False, False), ("| a | b |", False, False), ("12", False, True)], "p string, f boolean, l boolean")
    assert [r.y for r in rows.select(notes.paragraph_type(F.col("p"), F.col("f"), F.col("l")).alias("y")).collect()] == ["header", "body", "footnote", "table", "pagination"]


def test_page_sets(spark):
    assert column(spark, T.page_set, ["1-3,5,8-9", " 2 , 2", "5-3", "x", "0"]) == [[1, 2, 3, 5, 8, 9], [2], None, None, None]


def test_providers(spark):
    units = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "unit long, text string").coalesce(1)

    def translate(texts):
        if "t9" in texts:
            raise RuntimeError("down")
        return texts[:-1] if "t17" in texts else [x.upper() for x in texts]

    got = {r.unit: (r.translated, r.error) for r in providers.run_provider(units, translate).collect()}
    assert got[0] == ("T0", None) and got[8] == (None, "RuntimeError: down") and got[19][1].startswith("ValueError") and len(got) == 20
    delays = spark.createDataFrame([(1, 429), (9, 503), (1, 404), (2, None)], "n int, s int").select(providers.retry_delay(F.col("n"), F.col("s")).alias("y")).collect()
    assert [r.y for r in delays] == [2.0, 30.0, None, 4.0]


def test_manifest_and_review(spark):
    rows = spark.createDataFrame([("a/b.md", 5, "h"), ("x.exe", 1, "h"), ("y.csv", 200 * 1024 * 1024, "h")], "path string, bytes long, sha256 string")
    assert [r.decision for r in files.review_surface(rows).collect()] == ["suffix_not_allowed", "suffix_not_allowed", "too_large"]
    assert [r.role for r in files.artifact_manifest(rows, "b1").collect()] == ["edition", "other", "other"]


def test_masking(spark):
    terms = F.array(F.lit("NATO"), F.lit("a.b"))
    text = "NATO and NATOs, xNATO; a.b not axb"
    masked = column(spark, lambda c: folds.masked(c, terms), [text])[0]
    assert masked == "__QUIRE_PH_0000__ and NATOs, xNATO; __QUIRE_PH_0001__ not axb"
    assert column(spark, lambda c: folds.unmasked(c, terms), [masked]) == [text]
    note = "x {{NOTE_REF:1:r1}} y {{NOTE_REF:2:r2}}"
    rows = spark.createDataFrame([(note, note.upper().replace("NOTE_REF:1:R1", "NOTE_REF:1:r1").replace("R2", "r2")), (note, text)], "a string, b string")
    assert [r.y for r in rows.select(folds.same_placeholders(F.col("a"), F.col("b")).alias("y")).collect()] == [True, False]


def test_small_rules(spark):
    assert column(spark, notes.bridge_type, [[], ["blank"], ["illustration", "blank"], ["text", "map"], ["text"]], "array<string>") == ["adjacent", "blank", "illustration_and_blank", "map", "other"]
    assert column(spark, notes.printed_number, ["[12]", "- 7 -", "xii", None]) == [12, 7, None, None]
    assert column(spark, notes.truthy, [" Yes", "0", None, "TRUE"]) == [True, False, False, True]
    assert column(spark, lambda c: notes.marker_score(c, ["war", "king"]), ["War and kings, kings"]) == [3]
