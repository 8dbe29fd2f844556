"""Joins that form no pair but those that meet, against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import merge


def test_contained_items_of_every_length(spark):
    """Short items, other white space, items at both ends, repeated texts and ids, null and empty ones."""
    chance = random.Random(3)
    words = ["ab", "b", "abc", "the", "of", "cab", "é", "x"]
    space = lambda: chance.choice([" ", " ", " ", "\t", "\n", "  ", " "])
    make = lambda n: "".join(chance.choice(words) + space() for _ in range(n))
    docs = [(i, make(chance.randrange(1, 40))) for i in range(80)]
    items = []
    for i in range(150):
        text = chance.choice(docs)[1]
        low = chance.randrange(len(text))
        items.append((i, text[low : low + chance.choice([1, 2, 3, 5, 8, 13, 21, 60])]))
    items += [(200, ""), (201, None), (202, "not there at all of it"), (203, docs[0][1]), (204, " "), (205, "ab\tb"), (206, "zz")]
    docs += [(0, docs[5][1]), (None, docs[6][1]), (None, docs[7][1]), (80, None), (81, ""), (82, "zz"), (83, docs[0][1])]
    want = {(d, i) for d, text in docs for i, item in items if text and item and item in text}
    got = merge.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert merge.contained(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def plain_link(reference, notes):
    _, book, page, label = reference
    if None in (book, page, label):
        return "unresolved", None
    own = [n for n in notes if n[1] == book and n[2] == label]
    tiers = [[n[0] for n in own if n[4] == "footnote" and n[3] == page], [n[0] for n in own if n[4] == "chapter_endnote" and n[3] is not None and n[3] >= page], [n[0] for n in own if n[4] == "document_endnote"]]
    for tier in tiers:
        if tier:
            return ("linked", tier[0]) if len(set(tier)) == 1 else ("ambiguous", None)
    return "unresolved", None


def test_linked_notes(spark):
    chance = random.Random(4)
    pick = lambda *x: chance.choice(x)
    notes = [(i, pick("a", "b", None), pick("1", "2", "3", None), pick(1, 2, 3, 4, None), pick("footnote", "chapter_endnote", "document_endnote", "other", None)) for i in range(25)]
    references = [(i % 300, pick("a", "b", None), pick(1, 2, 3, 4, 5, None), pick("1", "2", "3", "4", None)) for i in range(320)]
    got = merge.linked_notes(
        spark.createDataFrame(references, "reference long, book string, page int, label string"), spark.createDataFrame(notes, "note_id long, book string, label string, page int, scope string")
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *plain_link(r, notes)) for r in references), key=repr)


def test_linked_notes_form_no_pairs(spark):
    """Of one label in one book, as many rows meet as there are references and notes."""
    n = 2000
    ids = spark.range(n)
    references = ids.select(F.col("id").alias("reference"), F.lit("a").alias("book"), (F.col("id") % 50).cast("int").alias("page"), F.lit("1").alias("label"))
    notes = ids.select(F.col("id").alias("note_id"), F.lit("a").alias("book"), F.lit("1").alias("label"), (F.col("id") % 50).cast("int").alias("page"), F.lit("chapter_endnote").alias("scope"))
    out = merge.linked_notes(references, notes)
    assert out.groupBy("status").count().collect() == [("ambiguous", n)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the notes are grouped by place before anything is joined with them
    assert "Aggregate [book" in plan and plan.count("Join") == 1
