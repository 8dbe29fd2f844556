"""The Merkle manifest against a tree built a node at a time."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quire.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each node what stands before and after its path on each level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            low = p // 16 * 16
            sides[i].append(("".join(nodes[low:p]), "".join(nodes[p + 1 : low + 16])))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], sides


def plain(rows: list[tuple]) -> list[tuple]:
    books = defaultdict(list)
    for d, source, lang, n, text in rows:
        lowered = text
        if text is not None and d is not None and zlib.crc32(str(d).encode()) % 5 == 0:
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = [h(*map(field, (d, source, lang, n, t))) for t in (text, lowered)]
        books[source].append((d, *leaf))
    order = sorted(books, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        books[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = tree([leaf for _, leaf, _ in books[source]])
    root, above = tree([trees[s][0] for s in order]) if order else ("", [])
    out = []
    for source, up in zip(order, above):
        for (d, leaf, node), own in zip(books[source], trees[source][1]):
            for before, after in own + up:
                node = h(before, node, after)
            out.append((d, leaf, trees[source][0], root, h(*(b + a for b, a in own + up)), node, node == root))
    return sorted(out, key=repr)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows_of(merkle.query(spark, sf_dir))
    assert got == plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.SQL})").fetchall(), key=repr)


def test_sources_of_many_buckets_and_many_sources(spark):
    """A source of over two buckets, sizes around powers of 16, and more sources than a run."""
    rows, sizes = [], {"hot": 2 * merkle.BUCKET + 17, "b": 1, "c": 16, "d": 17, "e": 256, "f": 257, "g": merkle.BUCKET, "h": merkle.BUCKET + 1}
    for name, n in (sizes | {f"s{i}": 1 + i % 3 for i in range(40)}).items():
        rows += [(len(rows) + i, name, "en", 1, f"Text {i}") for i in range(n)]
    random.Random(2).shuffle(rows)
    assert rows_of(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


@pytest.mark.parametrize("rows", [
    [(1, "a", "en", 3, "Abc")],
    [(None, None, None, None, None), (None, None, None, None, "A"), (None, "", "", 0, ""), (3, None, "en", 1, "é€"), (3, None, "en", 1, "é€"), (-7, "é", "x", -1, "Q" * 100_000), (3, None, "en", 2, "B")],
])
def test_odd_rows(spark, rows):
    """A lone row; nulls everywhere, repeated rows and ids, a long text, columns with clashing names."""
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], f"{SCHEMA}, h string, place long, root string, tree string")
    got = rows_of(merkle.manifest(docs))
    assert got == plain(rows)


def test_no_rows(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == COLUMNS and out.count() == 0
