"""Templates and segments: what goes in comes out, over every page and on tables made for it."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from quire.functions import contracts
from quire.plans import regions as plans

NOTE = re.compile(r"\{\{NOTE_REF:[^:}]+:[^}]+\}\}")


def plain_segments(text: str) -> list[str]:
    """The words of inner cells, between note placeholders, by one walk over the text's lines."""
    out = []
    for line in text.splitlines():
        for cell in line.split("|")[1:-1]:
            out += [x.strip() for x in NOTE.split(cell) if any(c.isalpha() for c in x)]
    return out


def test_every_page_comes_back(spark, sf_dir):
    pages = {r.page_id: r for r in plans.marked_pages(spark, sf_dir).withColumn("t", contracts.table_contract(F.col("text"))).collect()}
    results = {r.page_id: r for r in plans.table_contracts(spark, sf_dir).collect()}
    assert len(results) > 10
    seen = set()
    for i, p in pages.items():
        barred = sum(x.count("|") >= 2 for x in p.text.splitlines()) >= 2
        want = plain_segments(p.text) if barred else []
        if not want:
            assert p.t is None and i not in results
            continue
        assert "".join(t.literal if t.segment is None else t.segment for t in p.t) == p.text
        assert [t.segment for t in p.t if t.segment is not None] == want
        r = results[i]
        error = {1: "segment_ids", 3: "segment_ids", 4: "placeholders"}.get(i % 6)
        assert (r.segments, r.tokens, r.error) == (len(want), len(p.t), error)
        seen.add(error)
        if error is None:
            texts = iter(["again" if i % 6 == 2 and k == 0 else f"t{x}" for k, x in enumerate(want)])
            rebuilt = "".join(next(texts) if t.literal is None else t.literal for t in p.t)
            assert r.rebuilt_sha256 == hashlib.sha256(rebuilt.encode()).hexdigest()
        else:
            assert r.rebuilt_sha256 is None
    assert seen == {None, "segment_ids", "placeholders"}


def test_tables_by_hand(spark):
    texts = ["| a b | 12 |\n|---|:--:|\n| c{{NOTE_REF:1:r}} d |  |", "| a | b |", "x | y | z\r\n1 | 2 | 3\n", "| 1 | 2 |\n| 3 | 4 |", "", None, "|ä|\n|  é |tail|\x0bend"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", contracts.table_contract(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c and [t.segment for t in r.c if t.segment is not None] for r in rows] == [["a b", "c", "d"], None, ["y"], None, None, None, ["ä", "é", "tail"]]
    assert all("".join(t.literal if t.segment is None else t.segment for t in r.c) == r.t for r in rows if r.c)


def test_replies(spark):
    ask = lambda replies: spark.createDataFrame([("| a | b |\n| {{NOTE_REF:1:r}} c | 1 |", replies)], "t string, r array<struct<id:int,text:string>>").select(contracts.with_segments(contracts.table_contract(F.col("t")), F.col("r")).alias("x")).first().x
    assert tuple(ask([(2, " Z "), (0, "X"), (1, "Y")])) == ("| X | Y |\n| {{NOTE_REF:1:r}} Z | 1 |", None)
    assert ask([(0, "X"), (1, "Y")]).error == ask([(0, "X"), (1, "Y"), (2, "Z"), (3, "W")]).error == ask([]).error == ask([(0, "X"), (1, "Y"), (None, "Z")]).error == "segment_ids"
    assert ask([(0, "X"), (1, None), (2, "Z")]).error == "segment_text" and ask(None) is None
    assert ask([(0, "X"), (1, "Y"), (2, "Z"), (2, "last")]).text.endswith("last | 1 |")


def test_notes(spark):
    rows = [("a{{NOTE_REF:1:r}}b{{NOTE_REF:2:s}}", ["A", "B", ""]), ("a{{NOTE_REF:1:r}}b", ["A"]), ("none", ["none"]), (None, None), ("a{{NOTE_REF:1:r}}b", None)]
    df = spark.createDataFrame(rows, "t string, r array<string>")
    out = [r.y for r in df.select(contracts.with_notes(contracts.note_contract(F.col("t")), F.col("r")).alias("y")).collect()]
    assert out == ["A{{NOTE_REF:1:r}}B{{NOTE_REF:2:s}}", None, None, None, None]
