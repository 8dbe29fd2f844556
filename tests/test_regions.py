"""Joins of boxes against all pairs."""

from __future__ import annotations

import random

import pytest

from quire.operators import regions

SCHEMA = "page int, id long, x0 double, y0 double, x1 double, y1 double"


def ratio(a, b, smaller):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return max(0.0, w) * max(0.0, h) / max(min(size(a), size(b)) if smaller else size(a), 1e-9)


def made(n, seed, pages=3):
    chance = random.Random(seed)
    rows = []
    for i in range(n):
        # on, across and beyond the page, on the grid's lines, from specks to whole pages
        x, y, w, h = (chance.choice([chance.uniform(-0.5, 1.5), k / 8]) for k in (chance.randrange(9) for _ in range(4)))
        rows.append((chance.randrange(pages), i, x, y, x + w, y + h))
    nan = float("nan")
    return rows + [(0, n, None, 0.0, 1.0, 1.0), (0, n + 1, nan, 0.0, 1.0, 1.0), (0, n + 2, 0.5, 0.5, 0.5, 0.9), (None, n + 3, 0.0, 0.0, 1.0, 1.0), rows[0], (9, n + 4, 0.0, 0.0, 0.5, 0.5)]


def whole(r):
    return None not in r and all(v == v for v in r) and r[2] < r[4] and r[3] < r[5]


@pytest.mark.parametrize("of,threshold", [("left", 0.35), ("left", 1e-6), ("smaller", 0.5)])
def test_pairs(spark, of, threshold):
    left, right = made(120, 1), made(90, 2)
    want = sorted((a[1], b[1]) for a in left for b in right if whole(a) and whole(b) and a[0] == b[0] and ratio(a, b, of == "smaller") >= threshold)
    got = regions.overlapping(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["page"], threshold, of).collect()
    assert sorted((r.left.id, r.right.id) for r in got) == want
    assert all(abs(r.ratio - ratio((0, 0, *r.left[1:]), (0, 0, *r.right[1:]), of == "smaller")) < 1e-12 for r in got)


def test_first_matches_and_confirmed(spark):
    left, right = made(80, 3), [r for r in made(40, 4) if r[0] in (0, 1)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = regions.first_matches(a, b, ["page"], 0.35, "match").collect()
    key = lambda r: repr(tuple(r))
    want = [(*r, min((s[1] for s in right if whole(r) and whole(s) and r[0] == s[0] and ratio(r, s, False) >= 0.35), default=None)) for r in left]
    assert sorted(map(key, got)) == sorted(map(repr, want))
    got = regions.confirmed(a, b, ["page"]).collect()
    with_any = {s[0] for s in right}
    want = [(*r, r[0] not in with_any or any(whole(r) and whole(s) and r[0] == s[0] and ratio(r, s, True) >= 0.5 for s in right)) for r in left]
    assert sorted(map(key, got)) == sorted(map(repr, want))


def test_no_pair_is_formed_outside_a_shared_cell(spark):
    """Boxes apart on one page never meet: the join makes no row for them."""
    n = 8
    grid = [(0, i * n + j, i / n + 0.01, j / n + 0.01, i / n + 0.1, j / n + 0.1) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(grid, SCHEMA)
    met = regions.overlapping(df, df.withColumnRenamed("id", "other").withColumnRenamed("other", "id"), ["page"], 1e-9)
    assert met.count() == n * n
    assert "_x" in met._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_pages_of_few_boxes_are_one_cell(spark, monkeypatch, few):
    """The same pairs whichever pages are dealt to a grid; a page of few boxes is not copied to its cells."""
    monkeypatch.setattr(regions, "FEW", few)
    left, right = made(60, 5, pages=2) + made(9, 6, pages=5)[:9], made(50, 7, pages=2)
    want = sorted((a[1], b[1]) for a in left for b in right if whole(a) and whole(b) and a[0] == b[0] and ratio(a, b, False) >= 0.2)
    got = regions.overlapping(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["page"], 0.2).collect()
    assert sorted((r.left.id, r.right.id) for r in got) == want


def test_kinds_of_matches_take_one_join_of_boxes(spark):
    left, right = made(80, 8), [(*r, "AR"[r[1] % 2]) for r in made(60, 9) if r[0] is not None]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA + ", flag string")
    kinds = {"one": (["A"], 0.3), "two": (["R"], 0.5), "both": (["A", "R"], 0.3)}
    out = regions.matches(a, b, ["page"], {k: (lambda r, flags=flags: r["flag"].isin(flags), share) for k, (flags, share) in kinds.items()}, ("flag",))
    best = lambda r, flags, share: min((s[1] for s in right if s[6] in flags and whole(r) and whole(s) and r[0] == s[0] and ratio(r, s, False) >= share), default=None)
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(repr((*r, *(best(r, *k) for k in kinds.values()))) for r in left)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
