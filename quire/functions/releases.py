"""Rules on layouts, reviews and releases: gates as counts of violations, edits as folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Fixed values.
OBJECT_TYPES = ["prose", "heading", "list_entry", "figure", "caption", "table", "rotated_table", "multi_page_table", "footnote", "facsimile_region", "artifact"]
TABLES = ["table", "rotated_table", "multi_page_table"]
FURNITURE = ["header", "footer", "watermark", "page_number"]
SAFE_OVERFLOW = ["landscape_section", "safe_column_split"]


def layout_errors(o: Column, types: list[str] = OBJECT_TYPES) -> Column:
    """What is wrong with a layout object, in the order of the rules."""
    rules = [
        (~F.coalesce(o["object_type"].isin(types), F.lit(False)), "invalid object_type"),
        *((o[key].isNull(), f"missing {key}") for key in ("object_id", "source_pages", "bbox", "orientation", "reading_order", "confidence", "provenance", "render_policy")),
        (~F.coalesce(o["orientation"].isin(0, 90, 180, 270), F.lit(False)), "invalid orientation"),
        (F.coalesce(F.size(o["source_pages"]), F.lit(0)) <= 0, "source_pages must be non-empty"),
        (~F.coalesce(o["confidence"].between(0, 1), F.lit(False)), "confidence must be between 0 and 1"),
        (~F.coalesce(F.array_sort(F.map_keys(o["render_policy"])) == F.array(F.lit("evidence"), F.lit("reading")), F.lit(False)), "render_policy must define reading and evidence"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for test, code in rules)))


def checks(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(check, passed): whether each condition holds for all rows; a row of which it says nothing does not count against it."""
    one = rows.agg(*(F.coalesce(F.every(c), F.lit(True)).alias(name) for name, c in named.items()))
    return one.select(F.stack(F.lit(len(named)), *(x for name in named for x in (F.lit(name), F.col(name)))).alias("check", "passed"))


def object_checks(o: Column) -> dict[str, Column]:
    """The conditions of the quality gate that read layout objects."""
    table, read = o["object_type"].isin(TABLES), o["reading"] != "omit"
    implies = lambda a, b: ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    counted = o["column_count"].isNotNull() & o["header_row_count"].isNotNull() & ((o["row_count_status"] == "unresolved") | ((o["row_count_status"] == "resolved") & o["row_count"].isNotNull()))
    return {
        "numeric_unresolved_explicit": implies(table, o["numeric_status"].isin("resolved", "unresolved", "not_applicable")),
        "table_counts_accountable": implies(table, counted),
        "headers_footers_not_reading": implies(o["artifact_kind"].isin(FURNITURE), o["reading"] == "omit"),
        "reading_technical_labels_zero": ~F.coalesce(o["technical_label_visible"] & read, F.lit(False)),
        "reading_full_page_facsimiles_zero": ~F.coalesce((o["object_type"] == "facsimile_region") & (o["facsimile_scope"] == "full_page") & read, F.lit(False)),
        "landscape_tables_not_clipped": implies(table & ((o["object_type"] == "rotated_table") | o["wide"]), o["overflow_policy"].isin(SAFE_OVERFLOW)),
    }


def span_edits(text: Column, sha256: Column, edits: Column) -> Column:
    """struct(text, status): a text with edits (first, end, current, replacement) made from the last to the first.

    Nothing changes unless the text has the hash that was reviewed and each span holds what was reviewed there.
    """
    start = F.struct(text.alias("text"), F.lit(True).alias("ok"))

    def step(a: Column, e: Column) -> Column:
        there = F.substring(a["text"], e["first"] + 1, e["end"] - e["first"]) == e["current"]
        made = F.concat(F.left(a["text"], e["first"]), e["replacement"], F.substring(a["text"], e["end"] + 1, F.length(a["text"])))
        return F.struct(F.when(a["ok"] & there, made).otherwise(a["text"]).alias("text"), (a["ok"] & there).alias("ok"))

    folded = F.aggregate(F.reverse(F.array_sort(edits)), start, step)
    fits = F.sha2(text.cast("binary"), 256) == sha256
    return T.let(folded, lambda a: F.struct(
        F.when(fits & a["ok"], a["text"]).otherwise(text).alias("text"),
        F.when(~fits, "translation_changed").when(~a["ok"], "span_changed").when(a["text"] == text, "unchanged").otherwise("applied").alias("status"),
    ))


def worth_applying(correction: Column) -> Column:
    """Whether a correction of an object says anything: a text, a note, or a status that is not pending."""
    said = lambda name: T.strip(F.coalesce(correction[name], F.lit(""))) != ""
    status = F.lower(T.strip(F.coalesce(correction["review_status"], F.lit("pending"))))
    return said("corrected_source_text") | said("corrected_translated_text") | said("structure_note") | ~status.isin("", "pending")


def transport_calls(calls: Column, provider: Column, unit_ids: Column) -> Column:
    """Calls that a ledger row stands for, older rows included."""
    return F.when(calls.isNotNull(), calls).when(provider == "mock", 1).otherwise(F.coalesce(F.greatest(F.size(unit_ids), F.lit(0)), F.lit(0)))


def ocr_route(passed: Column, provider: Column, calls_allowed: Column, text: Column) -> Column:
    """struct(route, status): the page's own text, a mock review, vision, or a review with outside help."""
    there = F.when(T.strip(text) != "", "review_required").otherwise("unresolved")
    return (
        F.when(passed, F.struct(F.lit("python_text").alias("route"), F.lit("accepted").alias("status")))
        .when(provider == "mock", F.struct(F.lit("mock_vision_review").alias("route"), there.alias("status")))
        .when(provider.isNotNull() & calls_allowed, F.struct(F.lit("glm_vision").alias("route"), F.lit("accepted").alias("status")))
        .otherwise(F.struct(F.lit("web_assist").alias("route"), there.alias("status")))
    )


def early_index_entry(line: Column) -> Column:
    """struct(term, refs): an index line without its last reference, and the figures found among its last twenty characters."""
    term = F.regexp_replace(T.strip(F.regexp_replace(line, r",?\s*\d+\s*,?\s*$", "")), r",+$", "")
    refs = F.filter(F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1)), lambda r: F.contains(F.right(line, F.lit(20)), r))
    return F.struct(T.strip(term).alias("term"), refs.alias("refs"))


def clean_index_line(line: Column, corrections: dict[str, str] | None = None) -> Column:
    """An index line with single spaces, no soft hyphens, corrections made, and no space before signs."""
    out = T.strip(F.regexp_replace(F.replace(line, F.lit("­"), F.lit("")), f"{T.SPACE}+", " "))
    for old, new in (corrections or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(F.regexp_replace(out, r"\s+([,.;:])", "$1"), r",\s*,", ",")
    return F.regexp_replace(out, "^[ —]+|[ —]+$", "")
