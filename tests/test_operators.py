from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import book, keys, merge, queue
from quire.sources import files
from quire.streaming import events as streams


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_running_artifacts_are_found_and_stripped(spark):
    body = [f"Opening line number {i} of this page\nmore prose here {i}\nand more {i}\nand still {i}" for i in range(1, 5)]
    pages = spark.createDataFrame([("b", i, f"The Running Header\n{t}\n{i + 10}" if i != 4 else t) for i, t in enumerate(body, 1)], "source string, doc_id int, text string")
    found = book.running_artifacts(pages)
    assert rows(found, "key") == [("b", "the running header", 3)]
    out = rows(book.strip_running_artifacts(pages, found).select("doc_id", "text", "n_artifacts", "n_numbers"), "doc_id")
    assert out[0] == (1, f"{body[0]}\n11", 1, 0) and out[3] == (4, body[3], 0, 0)


def test_page_number_beside_a_header_goes(spark):
    pages = spark.createDataFrame([("b", i, f"{i}\nA Header Of Words\nprose {i} is here and it is long") for i in (1, 2)], "source string, doc_id int, text string")
    out = rows(book.strip_running_artifacts(pages, book.running_artifacts(pages)).select("text", "n_artifacts", "n_numbers"), "text")
    assert out == [("prose 1 is here and it is long", 1, 1), ("prose 2 is here and it is long", 1, 1)]


def test_logical_blocks(spark):
    pages = spark.createDataFrame([("b", 1, "it begins"), ("b", 2, "and goes on"), ("b", 3, "to its end."), ("b", 4, "new"), ("c", 1, "alone")], "source string, doc_id int, text string")
    out = rows(book.logical_blocks(pages).select("source", "first_page", "last_page", "fragments", "text_sha256"), "source", "first_page")
    assert out[0] == ("b", 1, 3, 3, hashlib.sha256(b"it begins and goes on to its end.").hexdigest()) and out[1][1:4] == (4, 4, 1) and len(out) == 3


def test_pages_are_numbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(book, "RANGE", 10)
    docs = spark.createDataFrame([(s, i, "it goes on" if i % 7 else "it ends.") for s in "ab" for i in range(3, 60, 2)] + [("a", None, "no id")], "source string, doc_id long, text string")
    pages = rows(book.numbered_pages(docs.select("source", "doc_id")).where("source = 'a'").select("page", "doc_id"), "page")
    assert pages == [(1, None)] + [(n, i) for n, i in enumerate(range(3, 60, 2), 2)]
    blocks = rows(book.logical_blocks(docs.where("source = 'b'")).select("first_page", "last_page"), "first_page")
    ends = [n for n, i in enumerate(range(3, 60, 2), 1) if i % 7 == 0]
    assert blocks == [(a + 1, b) for a, b in zip([0, *ends], [*ends, 29])]


def test_coverage_audit(spark):
    have = spark.createDataFrame([("b", 1), ("b", 2), ("b", 2), ("b", 5)], "source string, page int")
    want = spark.createDataFrame([("b", 1, 6), ("c", 1, 2)], "source string, first int, last int")
    assert rows(book.coverage_audit(have, want), "source") == [("b", 3, 1, 1), ("c", 2, 0, 0)]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        book.carry_batches(spark.createDataFrame([("b", 1)], "source string, page int"), 3, 3)


def test_canonical_json_is_pythons(spark):
    rows_ = [("a\"b\\c\n", 1, None), ("é", None, "x")]
    df = spark.createDataFrame(rows_, "s string, n int, m string")
    got = [r.y for r in df.select(keys.canonical_json(text=F.col("s"), number=F.col("n"), more=F.col("m")).alias("y")).collect()]
    assert got == [json.dumps({"more": m, "number": n, "text": s}, separators=(",", ":"), ensure_ascii=False) for s, n, m in rows_]


def test_precedence_hides_the_middle_whole(spark):
    base = spark.createDataFrame([(1, "b", "b"), (2, "b", "b"), (3, "b", "b")], "k int, x string, y string")
    middle = spark.createDataFrame([(1, "m", None), (2, "m", "m")], "k int, x string, y string")
    manual = spark.createDataFrame([(2, None, "h")], "k int, x string, y string")
    assert rows(merge.precedence(base, middle, manual, "k", ["x", "y"]), "k") == [(1, "m", "b", "middle"), (2, "b", "h", "manual"), (3, "b", "b", "base")]


def test_intervals_across_buckets(spark):
    points = spark.createDataFrame([("s", i) for i in (0, 5, 63, 64, 200)], "s string, p int")
    ranges = spark.createDataFrame([("s", 5, 64, "a"), ("s", 60, 300, "b"), ("t", 0, 999, "c")], "s string, lo int, hi int, name string")
    assert rows(merge.in_interval(points, ranges, "s", "p", "lo", "hi").select("p", "name"), "p", "name") == [(5, "a"), (63, "a"), (63, "b"), (64, "a"), (64, "b"), (200, "b")]


def test_reconciliation(spark):
    cache = spark.createDataFrame([(1, True), (2, False), (4, True)], "k int, valid boolean")
    state = spark.createDataFrame([(1, "pending"), (2, "validated"), (3, "validated"), (5, "pending")], "k int, status string")
    assert rows(merge.reconciled(cache, state, "k"), "k") == [(1, "validated", True), (2, "failed_retryable", True), (3, "failed_retryable", True), (4, "validated", True), (5, "pending", False)]


def test_batch_state_of_mixed_jobs(spark):
    jobs = spark.createDataFrame([(1, "queued"), (1, "paused"), (2, "completed"), (3, "failed"), (3, "cancelled"), (4, "cancelled")], "b int, state string")
    assert rows(queue.batch_state(jobs, "b").select("b", "batch_state"), "b") == [(1, "paused"), (2, "completed"), (3, "failed"), (4, "cancelled")]


EVENTS = [(1, 10, 1), (1, 10, 2), (1, 11, 1), (1, 12, 5), (1, 13, 2), (1, 14, 4), (1, 15, 3)]
DECISIONS = ["accepted", "duplicate", "out_of_order", "sequence_gap", "accepted", "sequence_gap", "accepted"]


def test_event_acceptance(spark):
    df = spark.createDataFrame([(s, i, e, q) for i, (s, e, q) in enumerate(EVENTS)], "stream long, arrival long, event_id long, sequence long")
    assert [r.decision for r in queue.accepted(df).orderBy("arrival").collect()] == DECISIONS


def test_event_acceptance_streamed(spark, tmp_path):
    schema = "stream long, event_id long, sequence long, arrival long"
    events = [(*e, i) for i, e in enumerate(EVENTS)]
    for i, part in enumerate((events[:3], events[:2:-1])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema(f"{schema}, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drained(streams.accepted(stream.select("stream", "event_id", "sequence", "arrival")))
    assert sorted((r.event_id, r.sequence, r.decision) for r in out.collect()) == sorted((e, q, d) for (_, e, q), d in zip(EVENTS, DECISIONS))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "i int, t string")
    files.write_jsonl(df, str(tmp_path / "x"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "x"), "i int, t string"), "i") == [(1, None), (2, "é")]
    assert '"t":null' in "".join(p.read_text() for p in (tmp_path / "x").glob("*.json"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"abc")
    (tmp_path / "f/A.BIN").write_bytes(b"abd")
    (tmp_path / "f/b.bin").write_bytes(b"x")
    got = rows(files.discover(spark, str(tmp_path / "f")).select("bytes", "sha256"), "bytes")
    assert len(got) == 2 and got[0] == (1, hashlib.sha256(b"x").hexdigest())


def test_import_codes(spark):
    df = spark.createDataFrame([("p", 1, "t"), ("p", 2, "t"), ("q", 3, "t"), ("q", 4, "t"), ("q", 5, " "), ("q", 6, None)], "project string, i int, text string")
    assert [r.code for r in files.import_codes(df, "project", "i", "text").orderBy("i").collect()] == ["accepted", "duplicate_in_project", "reused_immutable_source", "duplicate_in_project", "unreadable", "unreadable"]


def test_pages_get_their_own_running_lines_alone(spark):
    """Keys of a book are not carried to its pages, rows of one id are told by their texts, long lines and ß count as before."""
    header = "ß" * 50
    texts = [f"{header}\nfirst body\nw\ny\nz\nlast", f" {header.replace('ß', 'ss')} ...\nother body\nw\ny\nz\nend", "plain\r\ntext", None]
    pages = spark.createDataFrame([("b", 1, texts[0]), ("b", 1, texts[1]), ("b", None, texts[2]), (None, 4, texts[0])], "source string, doc_id int, text string")
    out = book.strip_running_artifacts(pages, spark.createDataFrame([("b", "ss" * 50), ("b", "unused")], "source string, key string"))
    assert sorted(map(tuple, out.select("source", "doc_id", "text", "n_artifacts").collect()), key=repr) == sorted(
        [("b", 1, "first body\nw\ny\nz\nlast", 1), ("b", 1, "other body\nw\ny\nz\nend", 1), ("b", None, "plain\ntext", 0), (None, 4, texts[0], 0)], key=repr
    )
    groups = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_set" in x]
    assert groups and all("doc_id" in x.split("], [")[0] for x in groups)


def test_running_counts_across_ranges(spark, monkeypatch):
    chance = random.Random(5)
    kinds = [chance.choice(["blank", "chapter", "appendix", "body", "body", "index"]) for _ in range(60)]
    rows_ = [("b", i, k) for i, k in enumerate(kinds, 1)] + [(None, i, k) for i, k in enumerate(["blank", "body", "body", "index", "blank", "index"], 1)]
    want = []
    for source, first in (("b", kinds), (None, [k for s, _, k in rows_ if s is None])):
        n, now = 0, ""
        for page, kind in enumerate(first, 1):
            if not ((kind == "blank" and n) or (kind == "body" and now == "chapter") or (kind == now and kind not in ("chapter", "blank"))):
                n, now = n + 1, "chapter" if kind == "body" and not n else kind
            want.append((source, page, n))
    for size in (1 << 20, 7):
        monkeypatch.setattr(book, "RANGE", size)
        pages = book.numbered_pages(spark.createDataFrame(rows_, "source string, doc_id long, kind string"))
        got = book.sections(pages)
        assert sorted(map(tuple, got.select("source", "page", "section").collect()), key=repr) == sorted(want, key=repr)
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
