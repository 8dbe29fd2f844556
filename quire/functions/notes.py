"""Notes, indexes, replies and regions: rules on short structured texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

#: What heads notes, what in it says they are a chapter's, and headings that close those.
NOTE_HEADING = (
    r"(?iU)^(?:notes?|endnotes?|notes?\s+to\s+(?:chapter|part|section).+|anmerkungen|endnoten|notas|notas\s+del\s+cap[ií]tulo.+|notes?\s+du\s+chapitre.+|注|注釈|註|尾注|章末注)$"
)
CHAPTER_NOTES = r"(?iU)chapter|part|section|chapitre|kapitel|cap[ií]tulo|章"
MAJOR_HEADING = r"(?iU)^(?:chapter|part|section|appendix|bibliography|references|index|chapitre|kapitel|cap[ií]tulo|annexe|bibliographie|参考文献|索引|第.+章)\b"
#: A note's number at a line's start, a footnote's bare mark, and what may refer to a note.
NOTE_START = rf"(?md)^{T.SPACE}*([0-9iIlLoO]{{1,4}})[.)]{T.SPACE}+"
BARE_NOTE = rf"(?sU)^{T.SPACE}*([*†‡]|\d{{1,4}})[.)]?{T.SPACE}+(.+)$"
NUMBER_REFERENCE = r"(?U)(?<!\d)([.!?][\"'’”)]?)(\d{1,4})(?=\s|$)"
SIGN_REFERENCE = r"(?U)(?<=[\p{L}\p{N}_\x02])(\s*)([*†‡])(?=\s|[),.;]|$)"


def heading_scope(c: Column) -> Column:
    """What a notes heading opens: "chapter_endnote" or "document_endnote"; null for other texts."""
    bare = T.strip(F.regexp_replace(c, f"{T.SPACE}+", " "))
    return F.when(bare.rlike(NOTE_HEADING), F.when(bare.rlike(CHAPTER_NOTES), "chapter_endnote").otherwise("document_endnote"))


def major_heading(c: Column) -> Column:
    return F.coalesce(T.strip(c).rlike(MAJOR_HEADING), F.lit(False))


def numbered_entries(c: Column, footnote: Column) -> Column:
    """The notes of a text in order, as array of (label, text): cut at numbers, or letters like them, at line starts; what stands
    before the first has no label. A footnote without one is read by its bare mark, if it has any."""
    parts = F.split(F.regexp_replace(c, NOTE_START, "\x01$1\x02"), "\x01")
    one = lambda p: F.struct(F.when(F.contains(p, F.lit("\x02")), F.substring_index(p, "\x02", 1)).alias("label"), T.strip(F.substring_index(p, "\x02", -1)).alias("text"))
    entries = F.filter(F.transform(parts, one), lambda e: e["text"] != "")
    bare = F.struct(F.regexp_extract(c, BARE_NOTE, 1).alias("label"), T.strip(F.regexp_extract(c, BARE_NOTE, 2)).alias("text"))
    by_mark = F.coalesce(footnote & (F.size(entries) > 0) & F.get(entries, F.lit(0))["label"].isNull() & (bare["label"] != ""), F.lit(False))
    return F.when(by_mark, F.array(bare)).otherwise(entries)


def safe_label(label: Column) -> Column:
    """A label fit for ids: other signs as hyphens, or the code of the first."""
    plain = F.regexp_replace(F.regexp_replace(label, "[^0-9A-Za-z_-]+", "-"), "^-+|-+$", "")
    return F.when(plain != "", plain).otherwise(F.concat(F.lit("u"), F.lpad(F.lower(F.hex(F.ascii(label))), 4, "0")))


def note_key(scope: Column, section: Column, label: Column) -> Column:
    return F.concat(section, F.lit("-"), scope, F.lit("-"), safe_label(label))


def reference_parts(c: Column) -> Column:
    """A text as array of (label, text, behind): what stands from one possible reference to the next, the first without label;
    behind: the place of the number that a sign follows, or null. Labels and texts in turn are the text."""
    numbers = F.regexp_replace(c, NUMBER_REFERENCE, "$1\x01$2\x02")
    parts = F.split(F.regexp_replace(numbers, SIGN_REFERENCE, "$1\x01$2\x02"), "\x01", -1)
    label = lambda p: F.when(F.contains(p, F.lit("\x02")), F.substring_index(p, "\x02", 1))
    rest = lambda p: F.when(F.contains(p, F.lit("\x02")), F.substring(p, F.locate("\x02", p) + 1, F.length(p))).otherwise(p)

    def one(parts: Column, p: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        follows = label(p).rlike("^[*†‡]$") & F.coalesce(label(before).rlike("^[0-9]") & (T.strip(rest(before)) == ""), F.lit(False))
        return F.struct(label(p).alias("label"), rest(p).alias("text"), F.when(follows, i - 1).alias("behind"))

    # the parts are found once, not for each of them again
    return T.let(parts, lambda parts: F.transform(parts, lambda p, i: one(parts, p, i)))


def note_entries(c: Column) -> Column:
    """Numbered notes of a text as (label, text); what stands before the first has label 0."""
    marked = F.regexp_replace(T.unix_lines(c), r"(?m)^[ \t]*(\d{1,4})[.)]\s+", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    label = lambda p: F.coalesce(F.regexp_extract(p, "^(\\d{1,4})\u0002", 1).try_cast("int"), F.lit(0))
    entries = F.transform(parts, lambda p: F.struct(label(p).alias("label"), T.strip(F.regexp_replace(p, "^\\d{1,4}\u0002", "")).alias("text")))
    return F.filter(entries, lambda e: e["text"] != "")


def roman_value(c: Column) -> Column:
    """The value of letters that stand for Roman figures, or null for others. Fixed values."""
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    figures = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.element_at(table, x))
    signed = F.transform(figures, lambda x, i: F.when(x < F.get(figures, i + 1), -x).otherwise(x))
    return F.when(c.rlike("^[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda a, x: a + x))


def note_label(label: Column, before: Column) -> Column:
    """A label read as a number: what follows the number before, of its letters as figures or as Roman ones; else figures if
    it has some or looks like them, else Roman ones, else as it is."""
    low = F.lower(label)
    figures = F.when(low.rlike("^[0-9ilo]+$"), F.translate(low, "ilo", "110").try_cast("int"))
    roman, expected = roman_value(low), before + 1
    return (
        F.when(figures == expected, figures.cast("string")).when(roman == expected, roman.cast("string"))
        .when(low.rlike("[0-9ol]") & figures.isNotNull(), figures.cast("string")).when(roman.isNotNull(), roman.cast("string")).otherwise(label)
    )


def reference_candidates(c: Column) -> Column:
    """Figures behind a sentence's end, in order: what may refer to a note."""
    return F.regexp_extract_all(c, F.lit(r"[.!?…][\"'”’)]?(\d{1,3})(?=\s|$)"), F.lit(1))


def index_entry(line: Column) -> Column:
    """struct(term, refs, target): an index line's term, pages and 'see' target."""
    see = F.regexp_extract(line, r"(?i)\.?\s*\bsee (?:also )?(.+)$", 1)
    head = F.regexp_replace(line, r"(?i)\.?\s*\bsee (?:also )?.+$", "")
    refs = F.regexp_extract_all(head, F.lit(r"\d{1,4}(?:[-–]\d{1,4})?"), F.lit(0))
    return F.struct(F.regexp_replace(T.strip(F.regexp_replace(head, r"[,;]?\s*\d[\d,;\s–-]*$", "")), "[,;]+$", "").alias("term"), refs.alias("refs"), F.when(see != "", T.strip(see)).alias("target"))


def raw_numbers(c: Column) -> Column:
    """Numbers as they stand, vulgar fractions among them."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*|[½¼¾⅓⅔⅛]"), F.lit(0)), "; ")


def fence_body(c: Column) -> Column:
    """A reply without its JSON code fence; null if the fence is broken."""
    value = T.strip(F.regexp_replace(c, "^﻿", ""))
    body = F.regexp_extract(value, r"(?is)^```(?:json)?[ \t]*\n(.*)\n[ \t]*```$", 1)
    return F.when(~value.startswith("```"), value).when(body != "", T.strip(body))


def group_parts(translation: Column, tokens: Column) -> Column:
    """A translation cut at its marker tokens, in order; null unless each stands in it once and in turn."""
    start = F.struct(F.array().cast("array<string>").alias("out"), translation.alias("rest"), F.lit(True).alias("ok"))

    def step(a: Column, token: Column) -> Column:
        at = F.call_function("instr", a["rest"], token)
        cut = F.when(at > 0, F.left(a["rest"], at - 1)).otherwise(F.lit(""))
        rest = F.when(at > 0, F.substring(a["rest"], at + F.length(token), F.length(a["rest"]))).otherwise(a["rest"])
        return F.struct(F.array_append(a["out"], T.strip(cut)).alias("out"), rest.alias("rest"), (a["ok"] & (at > 0)).alias("ok"))

    return F.aggregate(tokens, start, step, lambda a: F.when(a["ok"] & ~F.exists(tokens, lambda t: F.contains(a["rest"], t)), F.array_append(a["out"], T.strip(a["rest"]))))


def _compact(c: Column) -> Column:
    return T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{T.SPACE}+", " "))


def body_acceptance(u: Column, translation: Column) -> Column:
    """Why the translation of a unit (block_type, returned_type, source, before, after, terms) is refused, or accepted."""
    bare, source = T.strip(translation), T.strip(u["source"])
    words = F.size(F.filter(F.split(source, f"{T.SPACE}+"), lambda w: w != ""))
    body, n = u["block_type"] == "body", F.length(source)
    copied = lambda c: F.coalesce((c != "") & (bare == T.strip(c)), F.lit(False))
    terms = F.filter(F.transform(u["terms"], T.strip), lambda t: t != "")
    return (
        F.when(u["returned_type"] != u["block_type"], "block_type_mismatch").when(bare == "", "empty").when(copied(u["before"]), "copied_context_before").when(copied(u["after"]), "copied_context_after")
        .when(body & (bare == source) & (n > 30) & (words >= 5), "copied_source")
        .when(body & (n > 50) & (words >= 8) & (F.length(bare) < F.greatest(F.lit(8), F.floor(F.length(u["source"]) * 0.12))), "too_short")
        .when(F.size(terms) != F.size(F.array_distinct(terms)), "duplicate_terms").otherwise("accepted")
    )


def with_preserved_terms(translation: Column, terms: Column) -> Column:
    """The translation with the terms behind it that it should have kept and lacks. Fixed words."""
    lost = F.filter(F.filter(F.transform(terms, T.strip), lambda t: t != ""), lambda t: ~F.contains(translation, t))
    return F.when(F.size(lost) == 0, translation).otherwise(F.concat(T.rstrip(translation), F.lit("（原文保留："), F.array_join(lost, "；"), F.lit("）")))


def strict_acceptance(u: Column, translation: Column, titles: list[str]) -> Column:
    """As ``body_acceptance`` by the stricter rule: no complete source or context within it, no other block's id, and a length.
    Fixed values."""
    text, held = _compact(translation), lambda c: F.coalesce((_compact(c) != "") & F.contains(_compact(translation), _compact(c)), F.lit(False))
    others = F.filter(F.regexp_extract_all(translation, F.lit("logical2_[A-Za-z0-9]+"), F.lit(0)), lambda x: x != u["id"])
    least = F.when(u["block_type"].isin(titles), 1).otherwise(F.greatest(F.lit(12), F.floor(F.length(u["source"]) * 0.12)))
    return (
        F.when(u["returned_id"] != u["id"], "id_mismatch").when(u["returned_type"] != u["block_type"], "block_type_mismatch").when(held(u["source"]), "repeats_source")
        .when(held(u["before"]) | held(u["after"]), "context_leakage").when(F.size(others) > 0, "unrelated_id").when(F.length(T.strip(translation)) < least, "too_short").otherwise("accepted")
    )


def valid_box(b: Column) -> Column:
    """Whether four coordinates are there, ordered and within the unit square."""
    four = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    return F.coalesce(four & (b[0] < b[2]) & (b[1] < b[3]), F.lit(False))


def normalised_regions(regions: Column) -> Column:
    """struct(kept, dropped, review): regions of valid boxes with confidence held to 0..1; review if any fell or doubts."""
    kept = F.transform(F.filter(regions, lambda r: valid_box(r["bbox"])), lambda r: F.struct(r["type"].alias("type"), r["bbox"].alias("bbox"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"], F.lit(0.0)))).alias("confidence")))
    dropped = F.size(regions) - F.size(kept)
    return F.struct(kept.alias("kept"), dropped.alias("dropped"), ((dropped > 0) | F.exists(kept, lambda r: r["confidence"] < 0.5)).alias("review"))


def wrapped_lines(lines: Column, gap: float = 0.02, left: float = 0.025, font: float = 0.15) -> Column:
    """Sizes of paragraphs of lines (y0, y1, x0, font) in order: a line joins if it is near, aligned and alike in type."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("font"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["n"] > 0) & (x["y0"] - a["y1"] <= gap) & (F.abs(x["x0"] - a["x0"]) <= left) & (F.abs(x["font"] - a["font"]) <= font * F.greatest(a["font"], F.lit(1e-9)))
        return F.struct(
            F.when(joins | (a["n"] == 0), a["done"]).otherwise(F.array_append(a["done"], a["n"])).alias("done"), F.when(joins, a["n"] + 1).otherwise(1).alias("n"),
            x["y1"].alias("y1"), F.when(joins, F.least(a["x0"], x["x0"])).otherwise(x["x0"]).alias("x0"), F.when(joins, (a["font"] * a["n"] + x["font"]) / (a["n"] + 1)).otherwise(x["font"]).alias("font"),
        )

    return F.aggregate(lines, start, step, lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.array_append(a["done"], a["n"])))


def paragraph_type(p: Column, first: Column, last: Column) -> Column:
    """Type of a recognised paragraph: table, note, header, pagination or body."""
    bare = T.strip(p)
    return (
        F.when(bare.rlike(r"(?m)^\|.*\|\s*$"), "table").when(bare.rlike(r"^(?:\d{1,3}[.)]|[*†‡])\s+\S"), "footnote")
        .when((first | last) & bare.rlike(r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,8})[.!]?$"), "pagination").when(first & (F.length(bare) <= 60) & ~T.ends_sentence(bare), "header").otherwise("body")
    )


def bridge_type(between: Column) -> Column:
    """What lies between two body pages, by the roles of those pages: a map before an illustration before a blank."""
    has = lambda role: F.exists(between, lambda r: r == role)
    return (
        F.when(F.size(between) == 0, "adjacent").when(has("map"), "map").when(has("illustration") & has("blank"), "illustration_and_blank")
        .when(has("illustration"), "illustration").when(has("blank"), "blank").otherwise("other")
    )


def printed_number(label: Column) -> Column:
    """The number of a printed label without the brackets and signs around it, or null."""
    return F.regexp_replace(label, r"^[\s\[(【.-]+|[\s\])】.-]+$", "").try_cast("int")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(T.strip(c)).isin("1", "true", "yes", "y"), F.lit(False))


def marker_score(c: Column, markers: list[str]) -> Column:
    """Occurrences of any of the markers, regardless of case."""
    return sum((T.count_literal(F.lower(c), m) for m in markers), F.lit(0))
