"""Rules that read a sequence in order, as folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T


def clusters_from_first(values: Column, tolerance: float) -> Column:
    """Groups of sorted numbers within the tolerance of the group's first."""
    start = F.array().cast("array<array<double>>")

    def step(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        near = (F.size(groups) > 0) & (F.abs(x - last[0]) <= tolerance)
        grown = F.concat(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.array_append(last, x)))
        return F.when(near, grown).otherwise(F.array_append(groups, F.array(x)))

    return F.aggregate(F.array_sort(values.cast("array<double>")), start, step)


def clusters_from_mean(values: Column, tolerance: float) -> Column:
    """Sizes of groups of sorted numbers within the tolerance of the group's mean so far."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        near = (a["n"] == 0) | (F.abs(x - a["sum"] / F.greatest(a["n"], F.lit(1))) <= tolerance)
        return F.struct(
            F.when(near, a["done"]).otherwise(F.array_append(a["done"], a["n"])).alias("done"),
            F.when(near, a["sum"] + x).otherwise(x).alias("sum"), F.when(near, a["n"] + 1).otherwise(1).alias("n"),
        )

    return F.aggregate(F.array_sort(values.cast("array<double>")), start, step, lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.array_append(a["done"], a["n"])))


def replaced_in_turn(text: Column, found: Column, name: Callable[[Column], Column]) -> Column:
    """The text with each of the found strings' next occurrence replaced by a name made of its number."""
    start = F.struct(F.lit("").alias("out"), text.alias("rest"), F.lit(0).alias("i"))

    def step(a: Column, term: Column) -> Column:
        at = F.locate_column(term, a["rest"]) if hasattr(F, "locate_column") else F.call_function("instr", a["rest"], term)
        return F.struct(
            F.concat(a["out"], F.left(a["rest"], at - 1), name(a["i"])).alias("out"),
            F.substring(a["rest"], at + F.length(term), F.length(a["rest"])).alias("rest"), (a["i"] + 1).alias("i"),
        )

    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], a["rest"]))


PLACEHOLDER = "__QUIRE_PH_%04d__"


def protected(text: Column, pattern: str = T.LITERAL) -> Column:
    """struct(text, terms): matches replaced by numbered placeholders."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(replaced_in_turn(text, found, lambda i: F.format_string(PLACEHOLDER, i)).alias("text"), found.alias("terms"))


def restored(text: Column, terms: Column) -> Column:
    """The text with placeholders replaced by their terms; null unless each stands in it once."""
    keys = F.transform(terms, lambda _, i: F.format_string(PLACEHOLDER, i))
    count = lambda k: F.size(F.split(text, k)) - 1
    pairs = F.arrays_zip(keys.alias("k"), terms.alias("t"))
    return F.when(F.forall(keys, lambda k: count(k) == 1), F.aggregate(pairs, text, lambda a, p: F.replace(a, p["k"], p["t"])))


def table_cells(row: Column) -> Column:
    """Cells of a Markdown row."""
    bare = F.regexp_replace(T.strip(row), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|"), T.strip)


def rectangular(rows: Column) -> Column:
    """Rows of cells, padded with blanks to the longest."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def section_types(kinds: Column) -> Column:
    """For each of a book's page kinds the number of its section: start kinds open one, body continues a chapter, blanks extend."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), F.lit("").alias("now"))

    def step(a: Column, kind: Column) -> Column:
        stays = ((kind == "blank") & (a["n"] > 0)) | ((kind == "body") & (a["now"] == "chapter")) | ((kind == a["now"]) & ~kind.isin("chapter", "blank"))
        n = a["n"] + F.when(stays, 0).otherwise(1)
        now = F.when(stays, a["now"]).otherwise(F.when(kind == "body", "chapter").otherwise(kind))
        return F.struct(F.array_append(a["out"], n).alias("out"), n.alias("n"), now.alias("now"))

    return F.aggregate(kinds, start, step, lambda a: a["out"])


def index_parents(levels: Column) -> Column:
    """For each entry of an indented list the place of its parent, 0 for none: the last entry one level up that still stands."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.map_from_arrays(F.array(F.lit(-1)), F.array(F.lit(0))).alias("open"), F.lit(1).alias("i"))

    def step(a: Column, level: Column) -> Column:
        parent = F.coalesce(F.element_at(a["open"], (level - 1).cast("int")), F.lit(0))
        kept = F.map_filter(a["open"], lambda k, _: k < level)
        return F.struct(F.array_append(a["out"], parent).alias("out"), F.map_concat(kept, F.map_from_arrays(F.array(level.cast("int")), F.array(a["i"]))).alias("open"), (a["i"] + 1).alias("i"))

    return F.aggregate(levels, start, step, lambda a: a["out"])


def masked(text: Column, terms: Column) -> Column:
    """The text with each of the terms, where no letter adjoins, replaced by a placeholder of the term's number."""
    numbered = F.transform(terms, lambda t, i: F.struct(t.alias("t"), F.format_string(PLACEHOLDER, i).alias("k")))
    literal = lambda t: F.concat(F.lit("(?<![A-Za-z])\\Q"), t, F.lit("\\E(?![A-Za-z])"))
    return F.aggregate(numbered, text, lambda a, n: F.regexp_replace(a, literal(n["t"]), n["k"]))


def unmasked(text: Column, terms: Column) -> Column:
    numbered = F.transform(terms, lambda t, i: F.struct(t.alias("t"), F.format_string(PLACEHOLDER, i).alias("k")))
    return F.aggregate(numbered, text, lambda a, n: F.replace(a, n["k"], n["t"]))


def same_placeholders(source: Column, target: Column) -> Column:
    """Whether both hold the same note references in the same order."""
    found = lambda c: F.regexp_extract_all(c, F.lit(T.NOTE), F.lit(0))
    return found(source) == found(target)
