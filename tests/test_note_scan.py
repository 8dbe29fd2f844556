"""Notes of whole books against a reading from the first page to the last, whatever the ranges of pages."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.functions import notes as N
from quire.operators import note_scan
from quire.plans import regions as plans

HEADING = re.compile(r"(notes?|notes?\s+to\s+(?:chapter|part|section).+)", re.I)


def entries_of(text, footnote):
    """Cut at the numbers, by their places in the text."""
    marks = list(re.finditer(r"(?m)^\s*([0-9iIlLoO]{1,4})[.)]\s+", text))
    spots = [(0, None)] + [(m.end(), m.group(1)) for m in marks]
    ends = [m.start() for m in marks] + [len(text)]
    out = [(label, text[a:b].strip()) for (a, label), b in zip(spots, ends) if text[a:b].strip()]
    if footnote and out and out[0][0] is None and (m := re.match(r"\s*([*†‡]|\d{1,4})[.)]?\s+(.+)$", text, re.S)):
        return [(m.group(1), m.group(2).strip())]
    return out


def read_through(blocks):
    """Elements, notes and annotated texts of books, each read in order with all that is known so far in plain variables."""
    elements, found, texts, links = [], [], [], []
    books = defaultdict(list)
    for b in blocks:
        books[b.book].append(b)
    for book, rows in books.items():
        rows.sort(key=lambda b: (b.page, b.place))
        scope = opened = None
        section, last, number, current = 0, {}, {}, {}
        plans_here = []
        for b in rows:
            bare = " ".join(b.text.split())
            if HEADING.fullmatch(bare):
                scope, opened, section = ("chapter_endnote" if re.search("chapter|part|section", bare, re.I) else "document_endnote"), b.page, section + 1
                elements.append((book, b.page, b.place, "note_heading", scope, opened))
                continue
            if scope == "chapter_endnote" and b.chapter_boundary and re.match(r"(chapter|index)\b", b.text.strip(), re.I):
                scope = None
            if scope:
                elements.append((book, b.page, b.place, scope, scope, opened))
                kind, sid = scope, f"note-section-{section:04d}"
            elif b.footnote:
                kind, sid = "footnote", f"page-{b.page:04d}-footnotes"
            else:
                continue
            for k, (raw, text) in enumerate(entries_of(b.text, kind == "footnote")):
                label = note_scan.read_label(raw, number.get(sid))
                value = int(label) if label and label.isdigit() else None
                if value is not None and sid in number and value > number[sid] + 25:
                    current[sid]["text"] = current[sid]["text"].rstrip() + f"\n{label}. {text}"
                    current[sid]["folded"] += 1
                    continue
                key = f"{sid}-{kind}-{'u%04x' % ord(label) if label in '*†‡' else label}" if label else None
                current[sid] = {"book": book, "section": sid, "scope": kind, "page": b.page, "place": b.place, "entry": k, "label": label, "note_id": key, "continuation_of": None if key else last.get(sid), "text": text, "folded": 0}
                plans_here.append(current[sid])
                if key:
                    last[sid] = key
                if value is not None:
                    number[sid] = value
        found += plans_here
        by_label, count = defaultdict(list), Counter()
        for p in plans_here:
            if p["note_id"]:
                by_label[p["label"]].append(p)

        def target(label, page):
            own = by_label[label]
            tiers = [[p for p in own if p["scope"] == "footnote" and p["page"] == page], [p for p in own if p["scope"] == "chapter_endnote" and p["page"] >= page], [p for p in own if p["scope"] == "document_endnote"]]
            ids = {p["note_id"] for p in next((t for t in tiers if t), [])}
            return ids.pop() if len(ids) == 1 else None

        for b in rows:
            def put(m):
                label = m.group(2)
                note = target(label, b.page)
                if note is None:
                    return m.group(0)
                count[label] += 1
                ref = f"note-ref-p{b.page:04d}-{'u%04x' % ord(label) if label in '*†‡' else label}-{count[label]:03d}"
                links.append((book, b.page, b.place, label, note, ref))
                return f"{m.group(1)}{{{{NOTE_REF:{label}:{ref}}}}}"

            text = re.sub(r"(?<!\d)([.!?][\"'’”)]?)(\d{1,4})(?=\s|$)", put, b.text)
            text = re.sub(r"((?<=\w)\s*)([*†‡])(?=\s|[),.;]|$)", put, text)
            texts.append((book, b.page, b.place, hashlib.sha256(text.encode()).hexdigest()))
    return elements, found, texts, links


def rows_of(df, columns=None):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_over_the_table(spark, sf_dir):
    blocks = plans.noted_blocks(spark, sf_dir).cache()
    elements, found, texts, links = read_through(blocks.collect())
    columns = ["book", "section", "scope", "page", "place", "entry", "label", "note_id", "continuation_of", "text", "folded"]
    assert len(elements) > 20 and sum(p["folded"] for p in found) and {p["scope"] for p in found} == {"footnote", "chapter_endnote", "document_endnote"} and len(links) > 10
    for size in (1, 3, 4096):
        got = note_scan.note_blocks(blocks, size).select("book", "page", "place", "element", "scope", F.col("opened.page").alias("section_page"))
        assert rows_of(got) == sorted(elements, key=repr)
        assert rows_of(note_scan.note_plans(blocks, size), columns) == sorted((tuple(p[c] for c in columns) for p in found), key=repr)
    assert rows_of(plans.note_annotations(spark, sf_dir)) == sorted(texts, key=repr)
    assert rows_of(plans.note_reference_links(spark, sf_dir)) == sorted(links, key=repr)
    for name in ("note_blocks", "note_plans"):
        assert getattr(plans, name)(spark, sf_dir).count() == len(elements if name == "note_blocks" else found)


def test_transition_functions():
    """What a run of labels makes of each number before it, against the run itself."""
    import random

    chance = random.Random(2)
    signs = "0123456789ilo"
    for _ in range(60):
        raws = [chance.choice([None, "*", str(chance.randrange(120)), "".join(chance.choice(signs) for _ in range(chance.randrange(1, 5)))]) for _ in range(chance.randrange(9))]
        function = note_scan.transition(raws)
        for before in [None, *range(0, 140), 1234, 9999]:
            state = before
            for raw in raws:
                state = note_scan.moved(raw, state)[2]
            assert note_scan.applied(function, before) == state, (raws, before)


@pytest.mark.parametrize("raw,before,want", [("l2", 11, "12"), ("1O", 9, "10"), ("l2", 4, "12"), ("7", 1, "7"), ("007", 6, "007"), ("ii", 1, "2"), ("ii", None, "2"), ("i", None, "1"), ("lo", 3, "10"), ("*", 3, "*"), (None, 3, None), ("l", 49, "50")])
def test_labels_are_read_in_their_place(raw, before, want):
    assert note_scan.read_label(raw, before) == want


def test_odd_blocks(spark):
    """No blocks; null texts and books; a null boundary; notes without numbers."""
    schema = "book string, page int, place int, text string, chapter_boundary boolean, footnote boolean"
    empty = spark.createDataFrame([], schema)
    assert note_scan.note_plans(empty).count() == 0 and note_scan.annotated(empty, note_scan.note_plans(empty))[0].count() == 0
    rows = [(None, 1, 1, "Notes", None, None), (None, 1, 2, "no number\n1. one", None, False), (None, 2, 1, None, True, True), ("b", 1, 1, None, None, None), ("b", 1, 2, "see it.1 and", None, None), ("b", 1, 3, "1 bare mark", None, True)]
    blocks = spark.createDataFrame(rows, schema)
    plans_ = note_scan.note_plans(blocks)
    assert rows_of(plans_, ["book", "label", "text"]) == sorted([(None, None, "no number"), (None, "1", "one"), ("b", "1", "bare mark")], key=repr)
    texts, links = note_scan.annotated(blocks, plans_)
    assert rows_of(links, ["book", "label", "note_id"]) == [("b", "1", "page-0001-footnotes-footnote-1")]
    assert {(r.book, r.page, r.place): r.text for r in texts.collect()}[("b", 1, 2)] == "see it.{{NOTE_REF:1:note-ref-p0001-1-001}} and"


def test_texts_of_many_references_are_cut_once(spark):
    text = "".join(f"word{i}*, and an end.{i % 90} " for i in range(3000))
    began = time.monotonic()
    parts = spark.createDataFrame([(text,)], "t string").select(N.reference_parts(F.col("t")).alias("p")).first().p
    assert time.monotonic() - began < 20
    assert len(parts) == 6001 and "".join((p.label or "") + p.text for p in parts) == text
