"""Numbering and blocks on tables with repeated and null ids, null sources and several ranges."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.operators import book

SCHEMA = "source string, doc_id long, text string"
ODD = [
    ("a", None, "starts and goes on"), ("a", 1, "in the middle,"), ("a", 1, "still going on"), ("a", 2, "to the end."), ("a", 2, "to the end."), ("a", 9, None),
    (None, 1, "no source here"), (None, None, "and no id"), (None, 7, "but text"), ("b", 5, ""), ("b", 6, "lower case after nothing"), ("b", 1 << 62, "far away"), ("b", -(1 << 62), "Very early"),
]


def in_order(rows):
    """Each book's texts by id, null first; rows of one id in any order."""
    books = defaultdict(list)
    for source, i, text in rows:
        books[source].append((i is not None, i or 0, text))
    return {s: sorted(v, key=lambda r: r[:2]) for s, v in books.items()}


@pytest.mark.parametrize("size", [1 << 20, 3])
def test_every_row_is_in_one_block(spark, monkeypatch, size):
    monkeypatch.setattr(book, "RANGE", size)
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    texts = book.block_texts(docs).collect()
    assert sorted((r.source or "", r.text or "") for r in texts) == sorted((s or "", t or "") for s, _, t in ODD)
    pages = defaultdict(list)
    for r in texts:
        pages[r.source].append((r.page, r.text, r.block))
    for source, rows in in_order(ODD).items():
        got = sorted(pages[source], key=lambda r: r[0])
        assert [p for p, _, _ in got] == list(range(1, len(rows) + 1))
        # texts stand in order of ids, rows of one id in either order
        assert [r[:2] for r in rows] == [next(x[:2] for x in rows if x[2] == t) for _, t, _ in got]
        for (p, text, block), before in zip(got, [None, *got]):
            joined = before and before[1] is not None and text is not None and not before[1].rstrip().endswith(".") and text[:1].islower()
            assert block == (before[2] if joined else p)
    blocks = book.logical_blocks(docs).collect()
    assert sum(r.fragments for r in blocks) == len(ODD) == sum(r.fragments for r in book.joined_blocks(docs).collect())
    want = defaultdict(dict)
    for r in texts:
        want[(r.source, r.block)][r.page] = r.text
    for r in blocks:
        text = " ".join(t.strip() for _, t in sorted(want[(r.source, r.first_page)].items()) if t is not None)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.last_page - r.first_page + 1 == r.fragments


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_pages_beside_and_running_values(spark, monkeypatch, size):
    monkeypatch.setattr(book, "RANGE", size)
    rows = [(s, i * i * 1000 - 5, "x") for s, n in (("a", 40), ("b", 7), ("c", 8), (None, 1)) for i in range(n)]
    pages = book.numbered_pages(spark.createDataFrame(rows, SCHEMA))
    assert book.one_range(pages) == (size > 7)
    out = book.running(book.beside(book.beside(pages, "page", "doc_id"), "page", step=-1, name="before"), F.when(F.col("page") % 5 == 2, F.col("page")), "last").collect()
    assert len(out) == len(rows)
    last = {s: max(r.page for r in out if r.source == s) for s in ("a", "b", "c", None)}
    for r in out:
        assert r.doc_id == (r.page - 1) ** 2 * 1000 - 5
        assert r.next == (None if r.page == last[r.source] else (r.page + 1, r.page**2 * 1000 - 5))
        assert (r.before and r.before.page) == (r.page - 1 or None)
        assert r.last == (r.page - (r.page - 2) % 5 if r.page >= 2 else None)


def test_blocks_scan_thrice_and_exchange_seven_times(spark, sf_dir):
    """Marks, extent of the ids and texts are scanned; no exchange is by book alone but the numbering of one range."""
    plan = book.logical_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Exchange hashpartitioning") <= 5
