"""Contracts for replies: what must stay of a text is kept apart from what is translated, and put together again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

#: A cell that only rules a table off.
RULE = r"^:?-{3,}:?$"
#: Between the lines of a text, their ends kept.
BEFORE_LINE = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85  ])"
TOKEN = "array<struct<literal:string,segment:string>>"


def note_contract(c: Column) -> Column:
    """struct(markers, segments) of a text with note placeholders; null for a text without any."""
    markers = F.regexp_extract_all(c, F.lit(T.NOTE), F.lit(0))
    return F.when(F.size(markers) > 0, F.struct(markers.alias("markers"), F.split(c, T.NOTE, -1).alias("segments")))


def with_notes(contract: Column, translated: Column) -> Column:
    """The translated segments with the markers between them; null unless there are as many as the contract has."""
    put = F.transform(translated, lambda s, i: F.concat(s, F.coalesce(F.get(contract["markers"], i), F.lit(""))))
    return F.when(F.size(translated) == F.size(contract["segments"]), F.array_join(put, ""))


def _token(literal: Column | None = None, segment: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((null if literal is None else literal).alias("literal"), (null if segment is None else segment).alias("segment"))


def _translatable(x: Column) -> Column:
    """Tokens of a piece of a cell: its core is a segment if it has letters and is no rule; what stands around it is literal."""
    core = T.strip(x)
    lead = F.regexp_extract(x, f"^{T.SPACE}*", 0)
    trail = F.when(core == "", F.lit("")).otherwise(F.regexp_extract(x, f"{T.SPACE}*$", 0))
    words = core.rlike(r"\p{L}") & ~core.rlike(RULE)
    return F.array(_token(lead), F.when(words, _token(segment=core)).otherwise(_token(core)), _token(trail))


def _cell(c: Column) -> Column:
    markers = F.regexp_extract_all(c, F.lit(T.NOTE), F.lit(0))
    return F.flatten(F.transform(F.split(c, T.NOTE, -1), lambda x, i: F.concat(_translatable(x), F.array(_token(F.get(markers, i))))))


def _line(line: Column) -> Column:
    end = line.endswith("\n")
    content = F.when(end, F.left(line, F.length(line) - 1)).otherwise(line)

    def cells(parts: Column) -> Column:
        one = lambda p, i: F.concat(F.array(_token(F.when(i > 0, "|").otherwise(""))), F.when((i == 0) | (i == F.size(parts) - 1), F.array(_token(p))).otherwise(_cell(p)))
        return F.flatten(F.transform(parts, one))

    return F.concat(T.let(F.split(content, r"\|", -1), cells), F.array(_token(F.when(end, "\n").otherwise(""))))


def table_contract(c: Column) -> Column:
    """The template of a text with a table, array of (literal, segment), one of the two null: cells' words are segments, numbered from 0 in
    their order; bars, rules, figures, white space, note placeholders and text outside the bars are literals. Null for a text of
    fewer than two lines with two bars or without a segment."""
    lines = F.filter(F.split(c, BEFORE_LINE, -1), lambda x: x != "")
    barred = F.size(F.filter(lines, lambda x: T.count_literal(x, "|") >= 2)) >= 2
    tokens = F.filter(F.flatten(F.transform(lines, _line)), lambda t: t["segment"].isNotNull() | (t["literal"] != ""))
    return F.when(barred, T.let(tokens, lambda t: F.when(F.exists(t, lambda x: x["segment"].isNotNull()), t)))


def segments(template: Column) -> Column:
    """What is to be translated: array of (id, text)."""
    return F.transform(F.filter(template, lambda t: t["segment"].isNotNull()), lambda t, i: F.struct(i.alias("id"), t["segment"].alias("text")))


def with_segments(template: Column, replies: Column) -> Column:
    """struct(text, error): the template filled from replies, array of (id, text).

    The ids must be those of the segments, none missing and none foreign ("segment_ids"), each text given ("segment_text"); of a repeated id the last
    counts. Replies are stripped. The note placeholders must be the template's, in order ("placeholders").
    """
    n = F.size(F.filter(template, lambda t: t["segment"].isNotNull()))
    ids = F.array_sort(F.array_distinct(F.transform(replies, lambda r: r["id"].cast("int"))))
    fit = F.coalesce(ids == F.sequence(F.lit(0), n - 1), F.lit(False))
    given = F.forall(replies, lambda r: r["text"].isNotNull())

    def filled(by_id: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
        step = lambda a, t: F.struct((a["n"] + F.when(t["segment"].isNotNull(), 1).otherwise(0)).alias("n"), F.array_append(a["out"], F.coalesce(t["literal"], F.get(by_id, a["n"]))).alias("out"))
        return F.array_join(F.aggregate(template, start, step)["out"], "")

    last = lambda i: T.strip(F.element_at(F.filter(replies, lambda r: r["id"] == i), -1)["text"])
    text = F.when(fit & given, T.let(F.transform(F.sequence(F.lit(0), n - 1), last), filled))
    held = lambda c: F.regexp_extract_all(c, F.lit(T.NOTE), F.lit(0))
    source = F.array_join(F.transform(template, lambda t: F.coalesce(t["literal"], t["segment"])), "")
    error = F.when(~fit, "segment_ids").when(~given, "segment_text").when(held(text) != held(source), "placeholders")
    return F.when(template.isNotNull() & replies.isNotNull(), F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error")))
