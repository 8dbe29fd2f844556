"""Queries that SQL has no words for, against plain Python over the whole table."""

from __future__ import annotations

import re
from collections import defaultdict
from difflib import SequenceMatcher
from hashlib import sha256

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans import catalog, further


def test_edge_similarity(spark, sf_dir):
    books = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        books[r.source].append(r.text)
    bare = lambda t: re.sub("[^a-z0-9]+", "", t.lower())
    want = {}
    for source, texts in books.items():
        for page, (a, b) in enumerate(zip(texts, texts[1:]), 1):
            if a is not None and b is not None:
                want[source, page] = round(SequenceMatcher(None, bare(a[-80:]), bare(b[:80]), False).ratio(), 6)
    assert {(r.source, r.page): r.similarity for r in further.edge_similarity(spark, sf_dir).collect()} == want


#: Texts as they are scanned and as they should flow.
FLOWS = [
    ("one line\ngoes on", "one line goes on"), ("first\n\nsecond\nhalf", "first\n\nsecond half"), ("a hyphen-\nated word", "a hyphenated word"), ("two  spaces\t and\r\nline ends", "two spaces and line ends"),
    ("CHAPTER ONE\nIt began\nthere", "CHAPTER ONE\n\nIt began there"), ("It began\nCHAPTER TWO\nand went on", "It began\n\nCHAPTER TWO\n\nand went on"), ("- one\n- two\nmore", "- one\n\n- two\n\nmore"), ("1. first\n2) second", "1. first\n\n2) second"),
    ("Kapitel 3\nText", "Kapitel 3\n\nText"), ("第三章\n正文", "第三章\n\n正文"), ("", ""), (" \n \n\n ", ""), ("a\0b", "ab"), ("chapters follow\nhere", "chapters follow here"), ("IV. fourth\nrest", "IV. fourth\n\nrest"),
]


def test_reflow_by_hand(spark):
    df = spark.createDataFrame(FLOWS, "t string, want string")
    assert [(r.t, r.y) for r in df.select("t", "want", T.reflowed(F.col("t")).alias("y")).collect() if r.y != r.want] == []


def test_reflow_keeps_what_a_text_says(spark, sf_dir):
    """Over the whole table: signs stay in order but for hyphens at line ends, pieces are single lines, no paragraph is joined to another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashes = {r.doc_id: r.text_sha256 for r in catalog.QUERIES["reflow_text"](spark, sf_dir).collect()}
    joined = 0
    for r in docs.select("doc_id", "text", T.reflowed(F.col("text")).alias("flow")).collect():
        assert hashes[r.doc_id] == sha256(r.flow.encode()).hexdigest()
        signs = lambda t: re.sub(r"[\s\0-]+", "", t)
        assert signs(r.flow) == signs(r.text) and r.text.count("-") - r.flow.count("-") <= len(re.findall(r"\w-\s*\n", r.text))
        pieces = r.flow.split("\n\n") if r.flow else []
        assert all("\n" not in p and p == p.strip() and "  " not in p for p in pieces)
        paragraphs = [p for p in re.split(r"\n\s*\n", r.text) if p.strip()]
        lines = [x for x in r.text.split("\n") if x.strip()]
        assert len(paragraphs) <= len(pieces) <= len(lines)
        # the ends of paragraphs are ends of pieces
        ends, at = set(), 0
        for p in pieces:
            at += len(signs(p))
            ends.add(at)
        at = 0
        for p in paragraphs:
            at += len(signs(p))
            assert at in ends
        joined += len(lines) - len(pieces)
    assert joined > 0


def test_complete_context_reads_no_chapter_anew_for_each_row(spark, sf_dir):
    """Frames up to a chapter's end would take time in proportion to the square of its rows."""
    from quire.plans import roles

    plan = roles.complete_context(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
