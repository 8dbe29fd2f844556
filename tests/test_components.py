"""Components and blocks of fragments against a plain search, and picks against picking one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import components, queue


def reached(nodes, edges):
    beside = {}
    for a, b in edges:
        if a is not None and b is not None:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(set(nodes) | set(beside)):
        if n not in out:
            todo = [n]
            while todo:
                m = todo.pop()
                if m not in out:
                    out[m] = n
                    todo += beside.get(m, ())
    return {n: out[n] for n in set(nodes)}


def graphs():
    chance = random.Random(6)
    chain = list(range(1000))
    chance.shuffle(chain)
    yield [*range(1000)], list(zip(chain, chain[1:]))
    yield [1, 2, 2, 3, 7, 8], [(1, 2), (2, 1), (1, 1), (None, 3), (7, None), (8, 99), (99, 98), (50, 51)]
    yield [*range(300)], [(chance.randrange(300), chance.randrange(300)) for _ in range(200)]
    yield [*range(200)], [(0, i) for i in range(1, 150)]
    yield [5], []


@pytest.mark.parametrize("k", range(5))
def test_components(spark, k):
    nodes, edges = list(graphs())[k]
    got = components.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(set(nodes)) and {r.node: r.component for r in got} == reached(nodes, edges)


def test_reconstruction(spark):
    """Bridges over other fragments, each join in its own way, vetoes, repeated fragments and boundaries, null texts."""
    fragments = [(1, 1, "It was a long-"), (2, 2, "a caption"), (3, 3, " standing matter, and exam-"), (4, 4, ""), (5, 5, "ple of it"), (6, 6, "Vetoed"), (7, 7, None), (7, 7, None), (8, 8, "no hyphen"), (9, 9, "to take out"), (10, 10, "alone")]
    boundaries = [
        (1, 3, "preserve_lexical_hyphen", True, False), (3, 5, "remove_layout_hyphen", True, None), (5, 3, "remove_layout_hyphen", True, False), (5, 6, "insert_space", True, False), (6, 5, "insert_space", True, True),
        (7, 8, None, True, False), (8, 9, "remove_layout_hyphen", True, False), (9, 10, "insert_space", False, False), (None, 10, "insert_space", True, False), (10, 77, "insert_space", None, None),
    ]
    got = components.reconstructed(
        spark.createDataFrame(fragments, "node long, rank long, text string"), spark.createDataFrame(boundaries, "a long, b long, operation string, join boolean, veto boolean")
    )
    assert sorted(map(tuple, got.collect())) == [
        (1, 3, "preserve_lexical_hyphen,remove_layout_hyphen", "It was a long-standing matter, and example of it"), (2, 1, "", "a caption"), (4, 1, "", ""), (6, 1, "", "Vetoed"),
        (7, 3, "insert_space,insert_space", " no hyphen to take out"), (10, 1, "", "alone"),
    ]


def test_picks_are_those_of_picking_one_by_one(spark):
    chance = random.Random(4)
    rows = [(g, i, chance.randrange(4), chance.randrange(4), chance.random() < 0.6) for g in ("a", "b", "c", None) for i in range(30 if g == "a" else 5)]
    kinds = {"low": (F.col("fit"), F.array(-F.col("x"))), "both": (F.lit(True), F.array("x", "y")), "again": (F.lit(True), F.array("x", "y")), "none": (F.lit(False), F.array("x")), "rest": (~F.col("fit"), F.array("y"))}
    plain = {"low": (lambda r: r[4], lambda r: (-r[2],)), "both": (lambda r: True, lambda r: r[2:4]), "again": (lambda r: True, lambda r: r[2:4]), "none": (lambda r: False, lambda r: ()), "rest": (lambda r: not r[4], lambda r: (r[3],))}
    want = set()
    for g in {r[0] for r in rows}:
        used = set()
        for kind, (fit, score) in plain.items():
            pool = [r for r in rows if r[0] == g and fit(r) and r[1] not in used]
            if pool:
                best = max(pool, key=lambda r: (score(r), r[1]))[1]
                used.add(best)
                want.add((g, kind, best))
    got = queue.picked(spark.createDataFrame(rows, "g string, i long, x int, y int, fit boolean").repartition(4), "g", "i", kinds).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_table_of_edges_passes_through_the_driver(spark):
    """Small tables are not broadcast either: what the driver gets would grow with the fragments until they are too large."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)], "a long, b long")
    star = components._stars(edges)
    blocks = components.reconstructed(
        edges.select(F.col("a").alias("node"), F.col("a").alias("rank"), F.lit("x").alias("text")), edges.select("a", "b", F.lit("insert_space").alias("operation"), F.lit(True).alias("join"), F.lit(False).alias("veto"))
    )
    for df in (star, components.components(edges.select(F.col("a").alias("node")), edges), blocks):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
