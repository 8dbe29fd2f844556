"""Rules on roles, routes and boundaries: each an ordered CASE over the columns it reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that the rules of this module tell apart.
ROLES = [
    "cover", "half_title", "frontispiece", "title_page", "digitization_notice", "dedication", "contents", "list_of_illustrations", "preface", "chapter_open", "chapter_body",
    "full_page_illustration", "map", "table", "appendix", "index", "blank", "library_artifact", "back_cover", "unknown",
]
TRANSLATABLE = [
    "book_title", "subtitle", "chapter_title", "section_title", "subsection_title", "body", "footnote", "caption", "table_title", "table_cell", "epigraph", "other_translatable",
]
TITLES = ["book_title", "subtitle", "chapter_title", "section_title", "subsection_title"]
PAGE_FURNITURE = ["header", "footer", "page_number"]
DECORATION = ["watermark", "decorative_text", "decoration"]
ILLUSTRATED = ["illustration", "illustrated", "illustrated_page", "illustration_page", "image", "map"]
FIGURE_MARKS = ["digitized by microsoft", "univ calif"]
SCAN_MARKS = ["digitized by microsoft", "univ calif", "scanner attribution", "library artifact", "barcode"]
OVERLAYS = ["barcode", "binding_shadow", "scan_artifact", "overexposure", "underexposure"]
BREAKS = ["paragraph_break", "section_break", "chapter_break", "illustration_break"]
FUNCTION_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "who", "whose", "which", "that"]
LANGUAGES = ["en", "zh-Hans", "ja", "fr", "de", "es"]


def effective_type(block_type: Column, label: Column, text: Column, page_type: Column) -> Column:
    """The type that a block is translated as; null for blank text, page furniture and decoration."""
    from quire.functions.text import strip

    drawn = (block_type == "illustration") | (page_type.isin(ILLUSTRATED) & block_type.isin("body", "unknown", "caption"))
    return (
        F.when((strip(text) == "") | block_type.isin(PAGE_FURNITURE) | F.coalesce(label.isin(DECORATION), F.lit(False)), None)
        .when(F.coalesce(drawn, F.lit(False)), "caption")
        .when(block_type == "unknown", "other_translatable")
        .otherwise(block_type)
    )


def translatable(block_type: Column) -> Column:
    return block_type.isin(TRANSLATABLE)


def scan_artifact(text: Column) -> Column:
    """Whether a text holds a mark of digitisation, in any case and however it is spaced."""
    from quire.functions.text import SPACE

    return _marked(F.regexp_replace(text, f"{SPACE}+", " "), SCAN_MARKS)


def figure_artifact(text: Column) -> Column:
    """The rule on figures: fewer marks, spaced as they are written."""
    return _marked(text, FIGURE_MARKS)


def _marked(text: Column, marks: list[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for mark in marks:
        out = out | F.contains(low, F.lit(mark))
    return out


def flow_role(role: Column, prose: Column) -> Column:
    return (
        F.when(role == "chapter_open", "prose_anchor")
        .when((role == "chapter_body") | (role.isin("preface", "appendix") & prose), "prose_continuation")
        .when(role.isin("preface", "appendix"), "text_flow_none")
        .when(role.isin("blank", "full_page_illustration", "map"), "non_prose_bridge")
        .when(role.isin(ROLES), "structural_break")
        .otherwise("text_flow_none")
    )


def bridge_eligibility(role: Column, blank_kind: Column) -> Column:
    capable = role.isin("full_page_illustration", "map") | ((role == "blank") & ~blank_kind.eqNullSafe("unknown_blank"))
    return F.when(role == "chapter_body", "not_applicable").when(capable, "bridge_capable").otherwise("bridge_blocking")


def rendering_policy(role: Column) -> Column:
    """Whether a page's record, output, text flow and place in the book are kept."""
    flows = role.isin("chapter_body", "chapter_open", "preface")
    shown = role.isin([r for r in ROLES if r not in ("blank", "library_artifact", "digitization_notice", "back_cover", "unknown")])
    return F.struct(
        F.lit(True).alias("preserve_page_record"), shown.alias("include_in_default_output"), flows.alias("include_in_text_flow"), shown.alias("include_in_book_element_order"),
    )


def content_bearing(role: Column, prose: Column) -> Column:
    formal = [r for r in ROLES if r not in ("blank", "library_artifact", "digitization_notice", "back_cover", "unknown")]
    return role.isin(formal) | prose


def scan_flow_role(role: Column, prose: Column, bridge: Column) -> Column:
    return (
        F.when(prose, "prose_anchor")
        .when(bridge == "bridge_blocking", "structural_break")
        .when(role.isin("blank", "full_page_illustration", "map"), "non_prose_bridge")
        .otherwise("text_flow_none")
    )


def sanitized_features(features: Column, overlays: Column) -> Column:
    """Features without those that are overlays, and overlays with them, each once, in order."""
    moved = F.array_distinct(F.filter(features, lambda x: x.isin(OVERLAYS)))
    return F.struct(F.filter(features, lambda x: ~x.isin(OVERLAYS)).alias("features"), F.concat(overlays, F.array_except(moved, overlays)).alias("overlays"))


def route_policy(section_id: Column, section_type: Column, text: Column) -> Column:
    """The first rule that holds gives family, policies, replacement and provenance of a unit of front matter or body."""

    def route(family: str, translation: str, render: str, replacement: Column | str | None, provenance: str) -> Column:
        there = replacement if isinstance(replacement, Column) else F.lit(replacement).cast("string")
        parts = {"section_family": family, "translation_policy": translation, "render_policy": render}
        return F.struct(*(F.lit(v).alias(k) for k, v in parts.items()), there.alias("replacement_object_id"), F.lit(provenance).alias("provenance_status"))

    front = "front_matter"
    visual = F.concat(F.lit("canonical_"), section_type, F.lit("_object"))
    return (
        F.when(section_id.startswith("ch_"), route("chapter_body", "frozen_body", "render_existing", None, "active_frozen"))
        .when(scan_artifact(text), route(front, "non_translatable_artifact", "omit_from_reading", None, "artifact"))
        .when(section_id == "fm_list_of_illustrations", route(front, "superseded_provenance", "render_from_structured_object", "lo_illustration_list_0021_0022", "superseded"))
        .when(section_id == "fm_contents", route(front, "navigation_generated", "generated_navigation", "generated_contents_navigation", "navigation_source"))
        .when(section_type.isin("frontispiece", "map"), route(front, "reuse_existing", "render_from_structured_object", visual, "structured_visual_source"))
        .when(section_type.isin("half_title", "title_page"), route(front, "reuse_existing", "render_from_structured_object", "book_metadata_title_page", "structured_title_source"))
        .when(section_type == "cover", route(front, "reuse_existing", "evidence_only", "source_cover_object", "cover_source"))
        .otherwise(route(front, "reuse_existing", "render_existing", None, "active_reused"))
    )


def safe_merge(boundary: Column) -> Column:
    """Whether a reviewed boundary lets its two sides become one paragraph."""
    tests = (
        boundary["paragraph_continuation"].eqNullSafe(True) & boundary["structural_break"].eqNullSafe("none")
        & boundary["join_operation"].isin("concatenate_without_space", "concatenate_with_space")
        & boundary["human_review_status"].eqNullSafe("not_required") & boundary["status"].eqNullSafe("reviewed")
    )
    return F.coalesce(tests, F.lit(False))


def pair_resolution(b: Column) -> Column:
    """What the evidence of a pair of pages settles about their boundary, or null: break, join and three continuations."""

    def settled(kind: Column | str, join: str, word: bool, sentence: bool, paragraph: bool) -> Column:
        there = kind if isinstance(kind, Column) else F.lit(kind)
        flags = {"word_continuation": word, "sentence_continuation": sentence, "paragraph_continuation": paragraph}
        return F.struct(there.alias("structural_break"), F.lit(join).alias("join_operation"), *(F.lit(v).alias(k) for k, v in flags.items()))

    done, hyphen = b["model_status"] == "completed", b["visible_trailing_hyphen"]
    word, sentence, paragraph = (F.coalesce(b[f"{k}_continuation"], F.lit(False)) for k in ("word", "sentence", "paragraph"))
    runs_on = done & (b["structural_break"] == "none") & sentence & paragraph
    rescued = done & (b["structural_break"] == "paragraph_break") & sentence & ~F.coalesce(b["paragraph_continuation"], F.lit(True)) & ~hyphen & F.lower(b["left_token"]).isin(FUNCTION_WORDS)
    return (
        F.when(b["structural_break"].isin(BREAKS) & (b["join_operation"] == "no_join"), settled(b["structural_break"], "no_join", False, False, False))
        .when(runs_on & ~hyphen & b["join_operation"].isin("concatenate_with_space", "concatenate_without_space"), settled("none", "insert_space", False, True, True))
        .when(runs_on & hyphen & word & (b["join_operation"] == "concatenate_without_space"), settled("none", "remove_layout_hyphen", True, True, True))
        .when(runs_on & hyphen & (b["hyphen_type"] == "line_break_hyphen"), settled("none", "remove_layout_hyphen", True, True, True))
        .when(runs_on & hyphen & (b["hyphen_type"] == "lexical_hyphen"), settled("none", "preserve_lexical_hyphen", True, True, True))
        .when(rescued, settled("none", "insert_space", False, True, True))
    )


def pair_candidate(b: Column) -> Column:
    """An unresolved boundary between two fragments that are there."""
    there = b["next_page_available"] & b["next_fragment_id"].isNotNull()
    return (b["status"] == "unresolved") & there & ~b["previous_fragment_id"].startswith("fragment_missing_") & ~b["next_fragment_id"].startswith("fragment_missing_")


def known_language(value: Column, automatic: bool = False) -> Column:
    """The language if it is one of those supported, else null."""
    return F.when(value.isin([*LANGUAGES, *(["auto"] if automatic else [])]), value)
