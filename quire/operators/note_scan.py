"""Notes of a book: which blocks are notes, what each note says, and what refers to it.

Two rules carry a state through a book: the scope that a notes heading opens, and the last number of a section's notes, which
tells whether a number that jumps belongs to the note before. The first is the latest of some marks, so largest values of
windows by page range do. The second is a machine whose state is a number: each range of pages gives its transition
function, as intervals of the number before and what becomes of them; the functions are applied one after another, a row a range; then
each range runs again from the number it starts with. No task holds a book.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import notes as N
from quire.functions import text as T
from quire.operators.components import kept
from quire.operators.merge import linked_notes

#: Pages of a range, and the jump from which a number is no new note. The jump is a fixed value.
PAGES, JUMP = 4096, 25
#: Numbers that labels of four signs can have.
HIGHEST = 9999


def ranged(rows: DataFrame, value: Column, name: str, pages: int) -> DataFrame:
    """Adds the largest value of a book's blocks up to each, by (page, place), its own included: within its range and of those before."""
    rows = rows.withColumn("_range", F.floor(F.col("page") / pages)).withColumn("_own", value)
    within = F.max("_own").over(Window.partitionBy("book", "_range").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy("_book").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(F.col("book").alias("_book"), F.col("_range").alias("_r")).agg(F.max("_own").alias("_m")).select("_book", "_r", F.max("_m").over(before).alias("_carry"))
    joined = rows.withColumn("_within", within).join(carried, F.col("book").eqNullSafe(F.col("_book")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.greatest("_within", "_carry")).drop("_range", "_own", "_within", "_book", "_r", "_carry")


def note_blocks(blocks: DataFrame, pages: int = PAGES) -> DataFrame:
    """The blocks (book, page, place, text, chapter_boundary and others) that are notes headings or notes, with ``element`` and
    ``scope`` and ``opened``, the struct (page, place) of their section's heading.

    A notes heading opens its scope, the chapter's or the document's, until the next one; a major heading on a page that
    opens a chapter closes a chapter's. Pages and places of a book are told apart by their numbers; null texts are no headings.
    """
    at = F.struct("page", "place")
    scope = N.heading_scope(F.col("text"))
    opens = F.when(scope.isNotNull(), F.struct(F.col("page").alias("page"), F.col("place").alias("place"), scope.alias("scope")))
    closes = F.when(scope.isNull() & F.coalesce("chapter_boundary", F.lit(False)) & N.major_heading(F.col("text")), at)
    rows = ranged(ranged(blocks, opens, "_open", pages), closes, "_close", pages)
    closed = (F.col("_open.scope") == "chapter_endnote") & F.col("_close").isNotNull() & (F.col("_close") > F.struct(F.col("_open.page").alias("page"), F.col("_open.place").alias("place")))
    kept = rows.where(F.col("_open").isNotNull() & ~F.coalesce(closed, F.lit(False)))
    heading = N.heading_scope(F.col("text")).isNotNull()
    element = F.when(heading, "note_heading").otherwise(F.col("_open.scope"))
    return kept.select(*(F.col(f"`{c}`") for c in blocks.columns), element.alias("element"), F.col("_open.scope").alias("scope"), F.struct("_open.page", "_open.place").alias("opened"))


def label_number(raw: str) -> tuple[int | None, int | None]:
    """The numbers that a label's signs may stand for: as figures, and as Roman ones."""
    low = raw.lower()
    figures = low.translate(str.maketrans("ilo", "110"))
    worth = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    roman = sum(-worth[a] if b and worth[a] < worth[b] else worth[a] for a, b in zip(low, [*low[1:], ""])) if low and set(low) <= set(worth) else None
    return int(figures) if figures.isdigit() else None, roman


def read_label(raw: str | None, before: int | None) -> str | None:
    """A label as it is meant: the number after the one before, if its signs can stand for that; else as its signs look."""
    if raw is None or raw.isdigit():
        return raw
    figures, roman = label_number(raw)
    if before is not None and before + 1 in (figures, roman):
        return str(before + 1)
    plain = figures if set(raw.lower()) & set("0123456789ol") else None
    return next((str(n) for n in (plain, roman) if n is not None), raw)


def moved(raw: str | None, before: int | None) -> tuple[str | None, bool, int | None]:
    """(label, folded, number after): a number that jumps too far is folded into the note before and leaves the state."""
    label = read_label(raw, before)
    number = int(label) if label is not None and label.isdigit() else None
    if number is None or (before is not None and number > before + JUMP):
        return label, number is not None, before
    return label, False, number


def transition(raws: list[str | None]) -> tuple[int | None, list[tuple[int, int, int | None]]]:
    """What a run of labels makes of the number before: of none, and of intervals of numbers (null: the number stays)."""
    fresh: int | None = None
    known: dict[int, list[tuple[int, int]]] = {}
    open_ones = [(0, HIGHEST)]
    for raw in raws:
        fresh = moved(raw, fresh)[2]
        held: dict[int, list[tuple[int, int]]] = {}
        for number, spans in known.items():
            held.setdefault(moved(raw, number)[2], []).extend(spans)
        left = []
        # a label tells numbers apart at those it may follow and at those it is too far from
        cuts = sorted({c for v in (label_number(raw) if raw is not None else ()) if v is not None for c in (v - JUMP, v - 1, v)})
        for low, high in open_ones:
            edges = [low, *(c for c in cuts if low < c <= high), high + 1]
            for a, b in zip(edges, edges[1:]):
                _, folded, after = moved(raw, a)
                if folded or (after == a and moved(raw, b - 1)[2] == b - 1):
                    left.append((a, b - 1))
                else:
                    held.setdefault(after, []).append((a, b - 1))
        known, open_ones = held, left
    return fresh, [(a, b, n) for n, spans in known.items() for a, b in spans] + [(a, b, None) for a, b in open_ones]


def applied(function: tuple, before: int | None) -> int | None:
    fresh, cases = function
    if before is None:
        return fresh
    return next((before if n is None else n for a, b, n in cases if a <= before <= b), before)


def _runs(frames: Iterator[pd.DataFrame], keys: list[str], made: Callable[[tuple, list], dict]) -> Iterator[pd.DataFrame]:
    """A row for each run of rows of equal keys, which come sorted: of its key and of its values in column ``v``."""
    now, values, out = None, [], []
    for frame in frames:
        for *key, v in zip(*(frame[k] for k in keys), frame["v"]):
            key = tuple(None if x is None or x != x else x for x in key)
            if key != now:
                if now is not None:
                    out.append(made(now, values))
                now, values = key, []
            values.append(v)
        if len(out) > 1000:
            yield pd.DataFrame(out)
            out = []
    if now is not None:
        out.append(made(now, values))
    if out:
        yield pd.DataFrame(out)


def _replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, None
    for frame in frames:
        labels, folds = [], []
        for key, raw, start in zip(zip(frame["sid"], frame["r"]), frame["raw"], frame["start"]):
            if key != now:
                now, state = key, None if start is None or start != start else int(start)
            label, folded, state = moved(raw, state)
            labels.append(label)
            folds.append(folded)
        yield frame.assign(label=labels, folded=folds)[["sid", "page", "place", "entry", "label", "folded"]]


def read_labels(entries: DataFrame, pages: int = PAGES) -> DataFrame:
    """entries (sid, page, place, entry, raw) with ``label`` and ``folded``, each section's read in order of its places."""
    order = ["sid", "r", "page", "place", "entry"]
    rows = entries.select("sid", F.floor(F.col("page") / pages).alias("r"), "page", "place", "entry", "raw")
    dealt = rows.select(*order, F.col("raw").alias("v")).repartition("sid", "r").sortWithinPartitions(*order)
    functions = dealt.mapInPandas(lambda it: _runs(it, ["sid", "r"], lambda k, v: {"sid": k[0], "r": k[1], "v": json.dumps(transition(v))}), "sid string, r long, v string")

    def started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            starts = []
            for sid, v in zip(frame["sid"], frame["v"]):
                if sid != now:
                    now, state = sid, None
                starts.append(state)
                state = applied(json.loads(v), state)
            yield pd.DataFrame({"sid": frame["sid"], "r": frame["r"], "start": pd.array(starts, "Int64")})

    starts = functions.repartition("sid").sortWithinPartitions("sid", "r").mapInPandas(started, "sid string, r long, start long")
    again = rows.join(starts, ["sid", "r"]).repartition("sid", "r").sortWithinPartitions(*order)
    return again.mapInPandas(_replayed, "sid string, page long, place int, entry int, label string, folded boolean")


def note_plans(blocks: DataFrame, pages: int = PAGES) -> DataFrame:
    """book, sid, scope, page, place, entry, label, note_id, continuation_of, text and folded (how many numbers it swallowed) of
    each note of the blocks (as ``note_blocks``; with footnote, true for footnotes of their page).

    A block of notes is cut at its numbers; what stands before the first continues the note before. A number that jumps more than
    ``JUMP`` beyond the last of its section stays in the note before, as text. Footnotes are a section of their page.
    """
    # what several branches read is computed once, as a table in the shared folder
    found = kept(note_blocks(blocks, pages))
    sections = found.where("element = 'note_heading'").select("book", "opened", "scope").withColumn("nth", F.row_number().over(Window.partitionBy("book").orderBy("opened")))
    sections = sections.select(F.col("book").alias("_b"), F.col("opened").alias("_o"), F.format_string("note-section-%04d", "nth").alias("section"))
    listed = found.where("element <> 'note_heading'").join(sections, F.col("book").eqNullSafe(F.col("_b")) & (F.col("opened") == F.col("_o"))).select("book", "page", "place", "text", "scope", "section")
    loose = blocks.where("footnote").join(found.select(F.col("book").alias("_b"), F.col("page").alias("_p"), F.col("place").alias("_l")), F.col("book").eqNullSafe(F.col("_b")) & (F.col("page") == F.col("_p")) & (F.col("place") == F.col("_l")), "left_anti")
    loose = loose.select("book", "page", "place", "text", F.lit("footnote").alias("scope"), F.format_string("page-%04d-footnotes", "page").alias("section"))
    rows = listed.unionByName(loose)
    sid = F.concat(F.coalesce(F.concat(F.lit("="), "book"), F.lit("-")), F.lit("\x01"), F.col("section"))
    entries = rows.select("book", sid.alias("sid"), "scope", "section", F.col("page").cast("long").alias("page"), F.col("place").cast("int").alias("place"), F.posexplode(N.numbered_entries(F.col("text"), F.col("scope") == "footnote")).alias("entry", "e"))
    entries = entries.select("book", "sid", "scope", "section", "page", "place", "entry", F.col("e.label").alias("raw"), "e.text")
    entries = kept(entries)
    spot = ["sid", "page", "place", "entry"]
    read = entries.join(read_labels(entries, pages), spot)
    # a note and what is folded into it: in order, each that is not folded begins one
    w = Window.partitionBy("sid").orderBy("page", "place", "entry")
    read = read.withColumn("note", F.sum(F.when(F.col("folded"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("page", "place", "entry", "folded", F.when(F.col("folded"), F.concat(F.lit("\n"), "label", F.lit(". "), "text")).otherwise(F.col("text")).alias("text"))
    plans = read.groupBy("book", "sid", "scope", "section", "note").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min_by("label", F.struct("page", "place", "entry")).alias("label"))
    note_id = F.when(F.col("label").isNotNull(), N.note_key(F.col("scope"), F.col("section"), F.col("label")))
    plans = plans.withColumn("note_id", note_id)
    last = F.last("note_id", True).over(Window.partitionBy("sid").orderBy("note").rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("p")[0]
    text = F.aggregate(F.slice("p", 2, F.size("p")), first["text"], lambda t, x: F.concat(T.rstrip(t), x["text"]))
    return plans.withColumn("continuation_of", F.when(F.col("note_id").isNull(), last)).select(
        "book", "section", "scope", first["page"].alias("page"), first["place"].alias("place"), first["entry"].alias("entry"), "label", "note_id", "continuation_of", text.alias("text"), (F.size("p") - 1).alias("folded")
    )


def annotated(blocks: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, links): the blocks (book, page, place, text) with their references to notes as placeholders, and a row a link
    (book, page, place, nth, label, note_id, reference_id).

    A reference is a number behind a sentence's end or a sign behind a word whose label is one note for its page, by the tiers of
    ``linked_notes``; others stay as they are. References of a label are counted through a book. Blocks are told by book, page
    and place.
    """
    spot = ["book", "page", "place"]
    parts = kept(blocks.select(*spot, N.reference_parts(F.col("text")).alias("parts")))
    found = parts.select(*spot, F.posexplode("parts").alias("nth", "c")).where("c.label is not null").select(*spot, "nth", F.col("c.label").alias("label"), F.col("c.behind").alias("behind"))
    asked = found.select("book", "page", "label").distinct().withColumn("reference", F.struct("book", "page", "label"))
    known = kept(plans.where("note_id is not null").select("book", "label", "page", "scope", "note_id"))
    linked = linked_notes(asked, known).where("status = 'linked'").select("reference.*", "note_id")
    links = found.join(linked, ["book", "page", "label"])
    # a sign behind a number counts only if the number stays a number
    numbers = links.where(F.col("label").rlike("^[0-9]")).select(*spot, F.col("nth").alias("behind"), F.lit(True).alias("gone"))
    links = links.join(numbers, [*spot, "behind"], "left").where("gone is null")
    count = F.row_number().over(Window.partitionBy("book", "label").orderBy("page", "place", "nth"))
    safe = N.safe_label(F.col("label"))
    links = links.withColumn("reference_id", F.format_string("note-ref-p%04d-%s-%03d", F.col("page").cast("long"), safe, count))
    held = links.groupBy(*spot).agg(F.map_from_entries(F.collect_list(F.struct("nth", F.format_string("{{NOTE_REF:%s:%s}}", "label", "reference_id")))).alias("marks"))
    both = parts.join(held, spot, "left")
    put = F.transform("parts", lambda p, i: F.concat(F.coalesce(F.when(F.col("marks").isNotNull(), F.element_at(F.col("marks"), i)), p["label"], F.lit("")), p["text"]))
    return both.select(*spot, F.array_join(put, "").alias("text")), links.select(*spot, "nth", "label", "note_id", "reference_id")
