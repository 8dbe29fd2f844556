"""Removal of repeated byte strings against a table of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import oracles, suffix_dedup

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain(rows: list[tuple], keep: str, width: int = 200) -> list[tuple]:
    texts = [(i, (t or "").encode()) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    where = defaultdict(list)
    for i, (_, t) in enumerate(texts):
        for p in range(len(t) - width + 1):
            where[hashlib.md5(t[p : p + width]).digest()].append((i, p))
    out = []
    for i, (doc_id, t) in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            found = where[hashlib.md5(t[p : p + width]).digest()]
            if len(found) > 1 and (keep == "none" or found[0] != (i, p)):
                gone[p : p + width] = True
        edges = np.diff(np.r_[False, gone])
        spans = int((gone & np.r_[True, ~gone[:-1]]).sum()) if len(edges) else 0
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.withColumn("kept_sha256", F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_given_documents(spark, sf_dir, keep):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], keep)
    # a narrow sketch lets more through, to the same end
    assert rows_of(suffix_dedup.suffix_dedup(docs.repartition(5), keep=keep)) == want == rows_of(suffix_dedup.suffix_dedup(docs, keep=keep, bits=8))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in suffix_dedup.query(spark, sf_dir).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.SUFFIX_DEDUP})").fetchall(), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_common_passages_and_copies(spark, keep):
    """Anchors far beyond HOT: a passage in every text, near copies with an edit each, exact copies."""
    chance = random.Random(1)
    fresh = lambda n: "".join(chance.choice("abcdefgh ") for _ in range(n))
    passage, base = fresh(330), fresh(700)
    rows = [(i, fresh(chance.randrange(150)) + passage + fresh(chance.randrange(150))) for i in range(700)]
    for i in range(700, 1300):
        at = chance.randrange(700)
        rows.append((i, base[:at] + "X" + base[at + 1 :]))
    rows += [(i, base) for i in range(1300, 1320)] + [(i, fresh(400)) for i in range(1320, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(suffix_dedup.suffix_dedup(docs, keep=keep)) == plain(rows, keep)


ODD = [
    (None, None), (None, "n" * 250), (1, ""), (1, "x" * 199), (2, "y" * 200), (3, "y" * 200), (4, "z" * 201), (5, "ab" * 400), (6, "é" * 150 + "q"), (11, "w" + "é" * 150), (11, "v" * 260),
    (7, "\0" * 210), (8, "\0" * 199 + "a"), (9, "".join(map(chr, range(33, 123))) * 900), (10, "q" * 150 + "".join(map(chr, range(33, 123))) * 2),
]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_odd_rows(spark, keep):
    """Null ids and texts, empty and short ones, periodic and long ones, zero bytes, cuts within characters, clashing columns."""
    docs = spark.createDataFrame([(i, t, "k", 1, "c") for i, t in ODD], "doc_id long, text string, kept string, n long, code string")
    out = suffix_dedup.suffix_dedup(docs, keep=keep, carry=("kept",))
    assert rows_of(out.drop("rest")) == plain(ODD, keep)
    assert {r.kept for r in out.select("rest.kept").collect()} == {"k"}
    assert suffix_dedup.suffix_dedup(docs.limit(0), keep=keep).count() == 0


def test_rows_alike_in_id_and_text_all_go(spark):
    rows = [(1, "p" * 50 + "".join(map(chr, range(33, 123))) * 2), (1, "p" * 50 + "".join(map(chr, range(33, 123))) * 2)]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="none")
    assert [(r.n_removed, bytes(r.kept)) for r in out.collect()] == [(230, b"")] * 2


def test_longest_previous_factors():
    """The array against all pairs, on strings of few letters."""
    chance = np.random.default_rng(5)
    for n, letters in ((1, 2), (2, 1), (60, 2), (80, 3)):
        text = chance.integers(97, 97 + letters, n + 11).astype(np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(text, 12)[:n]
        order, common = suffix_dedup.suffixes(rows)
        assert [bytes(rows[i]) for i in order] == sorted(bytes(r) for r in rows)
        before, with_before, after, with_after = suffix_dedup.previous_factors(common, order)
        reach = lambda a, b: next((k for k in range(12) if rows[a][k] != rows[b][k]), 12)
        for k, i in enumerate(order.tolist()):
            longest = max((reach(i, j) for j in range(i)), default=0)
            assert max(with_before[k], with_after[k]) == longest
            for other, length in ((before[k], with_before[k]), (after[k], with_after[k])):
                assert other < 0 or (order[other] < i and reach(i, order[other]) == length)
        position = np.arange(n)
        equal = [[j for j in range(n) if j != i and bytes(rows[i]) == bytes(rows[j])] for i in range(n)]
        assert suffix_dedup.repeats(rows, position, True).tolist() == [any(j < i for j in e) for i, e in enumerate(equal)]
        assert suffix_dedup.repeats(rows, position, False).tolist() == [bool(e) for e in equal]


def test_equal_windows_have_equal_anchors():
    chance = np.random.default_rng(6)
    buf = chance.integers(0, 256, 200_000).astype(np.uint8)
    buf[150_000:150_900] = buf[60_000:60_900]
    at = np.array([0, 100, 65_600, 65_600, 200_000])
    anchor, places = {}, defaultdict(int)
    for found, keys, owner, begin, n, _ in suffix_dedup.segments(buf, at, 200, 128):
        for p in found.tolist():
            places[p] += 1
        for k, o, b, m in zip(keys.tolist(), owner.tolist(), begin.tolist(), n.tolist()):
            assert at[o] <= b and b + m + 199 <= at[o + 1] and m <= suffix_dedup.RUN
            anchor |= {b + i: k for i in range(m)}
    assert sorted(anchor) == [*range(100, 65_401), *range(65_600, 199_801)]
    assert all(anchor[150_000 + i] == anchor[60_000 + i] and places[anchor[60_000 + i]] >= 2 for i in range(700))


@pytest.mark.parametrize("width", [8, 13, 64, 200])
def test_hashes_tell_texts_of_one_edit_apart(width):
    """Texts that differ in one byte each, at all places, for hashes of any seed: none share a hash, nor does a text under two seeds."""
    base = np.random.default_rng(7).integers(97, 106, width + 100).astype(np.uint8)
    seen = {}
    for at in range(width + 100):
        for sign in (32, 88, 120, 255):
            text = base.copy()
            text[at] = sign
            hashes = [suffix_dedup.grams(text, width, seed) for seed in (0, 1, 2)]
            assert all(len(h) == 101 for h in hashes)
            for start in range(0, 101, 5):
                window = bytes(text[start : start + width])
                for seed, h in enumerate(hashes):
                    assert seen.setdefault((seed, int(h[start])), window) == window
    assert len({h for _, h in seen}) == len(seen)
