"""Alignment and comparison of texts against plain versions, over whole tables and on texts made for them."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.functions import alignment
from quire.plans import regions as plans


def plain_offsets(source: str, pages: list) -> list[tuple]:
    fold = lambda s: s.lower().replace("ß", "ss")
    words = [(fold(m.group()), m.start()) for m in re.finditer(r"\w+", source)]
    texts, cursor, out = [w for w, _ in words], 0, []
    for place in range(1, len(pages)):
        own = [fold(w) for w in re.findall(r"\w+", pages[place] or "")]
        hits = ((skip, p) for skip in range(min(4, len(own))) if len(own[skip : skip + 6]) >= 3 for p in range(cursor, len(texts)) if texts[p : p + len(own[skip : skip + 6])] == own[skip : skip + 6])
        skip, p = next(hits, (None, None))
        if p is None:
            out.append((place, round(len(source) * place / len(pages)), "proportional"))
        else:
            cursor = p
            out.append((place, words[p][1], "nearest_token" if skip else "exact_token"))
    return out


def plain_markers(text, offsets, source, labels):
    ends, placed = [i + 1 for i, c in enumerate(text) if c in "。！？；"], []
    for place, offset, _ in offsets:
        if labels[place] is not None:
            raw = round(len(text) * offset / max(1, len(source)))
            placed.append((min(ends, key=lambda e: abs(e - raw)) if ends else raw, f"\n\n【{labels[place]}】\n\n"))
    for at, mark in sorted(placed, reverse=True):
        text = text[:at] + mark + text[at:]
    return text


def test_page_offsets_over_the_table(spark, sf_dir):
    units = {r.conv_id: r for r in plans.unit_pages(spark, sf_dir).collect()}
    got = {}
    for r in plans.page_offsets(spark, sf_dir).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.offset, r.accuracy))
    assert {a for v in got.values() for *_, a in v} == {"exact_token", "nearest_token", "proportional"}
    for i, u in units.items():
        assert sorted(got.get(i, [])) == plain_offsets(u.source, u.pages)
    marked = {r.conv_id: r for r in plans.interior_markers(spark, sf_dir).collect()}
    for i, u in units.items():
        labels = [str(t) if t % 5 != 4 else None for t in u.turns]
        want = plain_markers(u.source.translate(str.maketrans(".!?;", "。！？；")), plain_offsets(u.source, u.pages), u.source, labels)
        assert marked[i].text_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_page_offsets_with_repeats_and_without_anchors(spark):
    rows = [
        ("a b c a b c a b c a b c d", ["a b c", "a b c", "a b c d", "b c d"]), ("one two", ["one", "two", None]), ("", ["", "x y z"]), ("x y z", ["x y z"]), ("x", []), (None, ["a", "b"]),
        ("Straße ÉTÉ naïve, l’été 12½ end", ["q", "STRASSE été NAÏVE l", "ete naïve l été"]), ("w " * 300 + "last words of it", ["w w w w", "w w w w w w w", "last words of it"]), ("a b", ["zz", "a b"]), ("p q r s t", ["q", "no q r s"]),
    ]
    df = spark.createDataFrame(rows, "source string, pages array<string>")
    out = df.select("source", "pages", alignment.page_offsets(F.col("source"), F.col("pages")).alias("o")).collect()
    for r in out:
        assert r.o is None if r.source is None else [tuple(x) for x in r.o] == plain_offsets(r.source, r.pages), r


def test_markers_of_long_units_take_time_in_proportion(spark):
    text = "An end here. Words go on, é! " * 4000
    df = spark.createDataFrame([(text, [str(i) for i in range(300)]), ("", ["0", "1", None]), ("no end", ["a", "b", "c"])], "s string, labels array<string>")
    offsets = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.struct(i.alias("place"), (F.length("s") * i / F.size("labels")).cast("int").alias("offset"), F.lit("").alias("accuracy")))
    target = F.translate("s", ".!?;", "。！？；")
    began = time.monotonic()
    rows = df.select("s", "labels", offsets.alias("o"), alignment.with_markers(target, offsets, F.length("s"), F.col("labels"))["text"].alias("m")).collect()
    assert time.monotonic() - began < 40
    for r in rows:
        assert r.m == plain_markers(r.s.translate(str.maketrans(".!?;", "。！？；")), r.o, r.s, r.labels)


def test_matching_blocks_are_those_of_the_library():
    chance = random.Random(8)
    for n, letters in ((0, "a"), (40, "ab"), (300, "abc d"), (900, "abcdefgh "), (500, "é😀x")):
        for _ in range(6):
            a = "".join(chance.choice(letters) for _ in range(n))
            b = list(a)
            for _ in range(n // 20):
                i = chance.randrange(len(b))
                b[i : i + chance.randrange(9)] = chance.choice(["", "q", "zz z", a[:30]])
            for other in ("".join(b), "".join(chance.choice(letters) for _ in range(n + 7)), ""):
                want = [tuple(m) for m in SequenceMatcher(None, a, other, False).get_matching_blocks()[:-1]]
                assert alignment.matching_blocks(a, other) == want


def test_matching_blocks_of_pages_are_those_of_the_library_and_found_in_a_share_of_its_time():
    chance = random.Random(3)
    words = ["".join(chance.choice("etaoinshr") for _ in range(chance.randrange(2, 9))) for _ in range(400)]
    spent, plain = 0.0, 0.0
    for case in range(6):
        a = ". ".join(" ".join(chance.choice(words) for _ in range(chance.randrange(3, 15))) for _ in range(12)) + ("ab" * 150 if case == 4 else "")
        b = re.sub(r"([.]) +\S+", r"\1", a).replace("e ", "e,- ")
        b = b + a[:300] if case == 5 else b
        began = time.process_time()
        got = alignment.matching_blocks(a, b)
        middle = time.process_time()
        assert got == [tuple(m) for m in SequenceMatcher(None, a, b, False).get_matching_blocks()[:-1]]
        spent, plain = spent + middle - began, plain + time.process_time() - middle
    assert spent < plain / 4


def test_matching_blocks_take_memory_in_proportion_to_the_texts(monkeypatch):
    """A line that goes on, of which the other text has every second word, takes a cut for each word of many runs: the runs are held once. Those
    listed are bounded, whatever the bound, with the same blocks."""
    chance = random.Random(5)
    words = ["".join(chance.choice("ETAOINSHR") for _ in range(chance.randrange(2, 7))) for _ in range(101)]
    b = "".join(w + "!! " for w in words) * 59
    a = re.sub(r"([.!?]) +\S+", r"\1", b)
    tracemalloc.start()
    got = alignment.matching_blocks(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert got == sorted(got) and all(a[i : i + k] == b[j : j + k] for i, j, k in got)
    for most, closer in ((0, 16), (5, 1), (60, 16), (1000, 4)):
        monkeypatch.setattr(alignment, "RUNS", most)
        monkeypatch.setattr(alignment, "CLOSER", closer)
        for start, letters in ((0, "ab"), (3000, "abcdefgh "), (6000, "é😀x")):
            left = a[start : start + 500] + "".join(chance.choice(letters) for _ in range(200))
            right = "".join(chance.choice(letters) for _ in range(200)) + b[start : start + 900]
            assert alignment.matching_blocks(left, right) == [tuple(m) for m in SequenceMatcher(None, left, right, False).get_matching_blocks()[:-1]]


def test_compared_with_nulls_other_spaces_and_more_rows_than_are_strings_at_once(spark):
    texts = [("Ｆｏｏ\u2003\u2029bar ﬁn ", "foo bar fin\x1d", "FOO  BAR", "①"), (None, None, None, None), ("Straße 12", None, "STRASSE", "12"), (None, "x y", "x", ""), ("", "\u3000", " ", " ")]
    rows = [(i, *texts[i % 5]) for i in range(2 * alignment.ROWS + 9)]
    df = spark.createDataFrame(rows, "i int, body string, layer string, header string, number string").coalesce(1)
    got = {r.i: r.c for r in df.select("i", alignment.compared(*map(F.col, ("body", "layer", "header", "number")), F.array(F.col("i"))).alias("c")).collect()}
    want = [(0.909091, ["f"], ["F"], True, False), (1.0, [], [], False, False), (0.0, [], ["Straße 12"], True, True), (0.0, ["x y"], [], False, False), (1.0, [], [], False, False)]
    assert len(got) == len(rows)
    for i, c in got.items():
        assert (c.similarity, c.missing, c.added, c.header_in_body, c.number_in_body) == want[i % 5]


def test_hyphens_at_ends_of_lines_of_all_kinds_and_signs_are_counted(spark):
    rows = [("end-\u2029 of -\x1c\r\nx-y -\u3000 ", None), ("a-", "b-\r\nc-\x85d -\u2028"), ("—–(“x”)…-", "no, -\t\n")]
    df = spark.createDataFrame(rows, "body string, layer string").select(alignment.compared(F.col("body"), F.col("layer"), F.lit(""), F.lit(""), F.array(F.lit(1))).alias("c"))
    assert [(r.c.hyphens, r.c.punctuation) for r in df.collect()] == [(3, 4), (2, 2), (0, 5)]


def test_page_comparison_over_the_table(spark, sf_dir):
    rows = {r.doc_id: r for r in plans.compared_pages(spark, sf_dir).collect()}
    plain = lambda s: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s or "")).strip()
    seen = 0
    for r in plans.page_comparison(spark, sf_dir).collect():
        p = rows[r.doc_id]
        a, b = plain(p.layer), plain(p.text)
        assert (r.body_chars, r.layer_chars) == (len(p.text), len(p.layer))
        assert r.header_in_body == bool(plain(p.header) and plain(p.header).casefold() in b.casefold()) and r.number_in_body == (p.number in b)
        assert r.order_reasonable == (p.orders == sorted(set(p.orders)))
        count = lambda s: sum(c in alignment.PUNCTUATION for c in s)
        assert r.punctuation == abs(count(p.text) - count(p.layer)) and r.hyphens == abs(sum(x.rstrip().endswith("-") for x in p.text.splitlines()) - sum(x.rstrip().endswith("-") for x in p.layer.splitlines()))
        if len(a) > 2500:
            continue
        seen += 1
        m = SequenceMatcher(None, a, b, False)
        cut = lambda s, kind: [v.strip()[:160] for tag, i, j, k, n in m.get_opcodes() if tag in (kind, "replace") for v in [s[i:j] if kind == "delete" else s[k:n]] if v.strip()][:12]
        assert (r.similarity, r.missing, r.added) == (round(m.ratio(), 6), cut(a, "delete"), cut(b, "insert"))
    assert seen > 50


def test_term_occurrences(spark):
    """Places by number in whatever case, letters of other cases for one character each, nulls; a text of many terms takes no time
    in proportion to the square of their occurrences."""
    rows = [
        ("𝒜 Red Fox met a Red Fox. NATO", "İn RED FOX, red foX, nato ſ"), ("Kiss Kiss Kiss", "\u212aiſs kiſS"), ("no terms, The. Human", "x"), (None, "x"), ("Alpha beta", None), ("AbcAbc, Abc", "ABCABCABC"),
    ]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(alignment.term_occurrences(F.col("a"), F.col("b")).alias("o"))
    got = [r.o and [(o.term, o.nth, o.source_start, o.translated_start, o.before, o.after, o.action[0]) for o in r.o] for r in df.collect()]
    assert got[0] == [("Red Fox", 1, 2, 3, "𝒜", "met a Red Fox. NATO", "c"), ("Red Fox", 2, 16, 12, "𝒜 Red Fox met a", ". NATO", "c"), ("NATO", 1, 25, 21, "𝒜 Red Fox met a Red Fox.", "", "c")]
    assert [o[:4] for o in got[1]] == [("Kiss Kiss Kiss", 1, 0, None)]
    assert got[2] == [] and got[3] is None
    assert [o[:4] for o in got[4]] == [("Alpha", 1, 0, None)]
    assert [o[:4] for o in got[5]] == [("AbcAbc", 1, 0, 0), ("Abc", 1, 0, 0), ("Abc", 2, 3, 3), ("Abc", 3, 8, 6)]
    # 40,000 places of one term: as many folds over what stands before each took minutes
    many = spark.createDataFrame([("Alpha x. " * 40_000, "alpha " * 40_000)], "a string, b string").select(F.size(alignment.term_occurrences(F.col("a"), F.col("b"))).alias("n"))
    start = time.time()
    assert many.first().n == 40_000
    assert time.time() - start < 30
