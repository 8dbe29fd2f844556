"""Centroid clustering against plain integers, and its behaviour on odd rows."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quire.llm import centroids

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows: list[tuple], k: int = 16, rounds: int = 3, width: int = 64) -> list[tuple]:
    """The contract in Python's integers, a vector at a time."""
    kept = [(i, [math.floor(Fraction(float(x)) * 64) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in seeds[:k]]
    if not c:
        return []
    away = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda v: min((away(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v)[1] == n] for n in range(len(c))]
        c = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c[n] for n, vs in enumerate(own)]
    last = [(i, *near(v)) for i, v in kept]
    fits = lambda x: x if x < 2**63 else None
    total = {n: sum(d for _, d, m in last if m == n) for n in range(len(c))}
    return [(i, n, fits(d), fits(total[n]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in last]


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_given_vectors(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = rows_of(centroids.query(spark, sf_dir))
    assert got == sorted(plain(rows), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({centroids.SQL})").fetchall(), key=repr)


@pytest.mark.parametrize("size", [1.0, 3e5, 1e9, 1e30])
def test_every_magnitude_is_exact(spark, size):
    """Doubles, 64-bit integers and Python's integers, by the size of the components; few vectors and empty clusters."""
    chance = np.random.default_rng(3)
    rows = [(i, [float(x) for x in chance.normal(size=64) * size]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert rows_of(centroids.cluster(table)) == sorted(plain(rows), key=repr)


def test_the_bound_decides_the_kind():
    assert [centroids.kind_for(b) for b in (2**53 - 1, 2**53, 2**63 - 1, 2**63)] == [np.float64, np.int64, np.int64, object]
    # beyond 2**53 doubles would no longer tell these apart
    x, c = np.array([[2**31 + 1, 0]]), np.array([[2**31, 1], [2**31, 0]])
    for shift in (0, 2**20):
        chosen, distance = centroids.nearest(x + shift, c + shift)
        assert (chosen.tolist(), distance.tolist()) == ([1], [1])


def test_odd_rows(spark):
    """Nulls, other lengths, repeated rows and ids, a null id, clashing columns."""
    v = [[float(i + j) for j in range(64)] for i in range(4)]
    bad = [None, [], v[0][:63], v[0] + [1.0], v[0][:63] + [None], v[0][:63] + [float("nan")], v[0][:63] + [float("inf")]]
    rows = [(1, v[0]), (1, v[0]), (2, v[1]), (2, v[2]), (None, v[3]), *((9, b) for b in bad)]
    table = spark.createDataFrame([(i, x, 7, "c", 0) for i, x in rows], "vec_id long, embedding array<double>, cluster int, inertia string, total int")
    got = rows_of(centroids.cluster(table))
    assert len(got) == 5 and got == sorted(plain(rows), key=repr)
    assert rows_of(centroids.cluster(table.where("vec_id = 9"))) == [] == rows_of(centroids.cluster(table.where("vec_id is null")))
    assert centroids.cluster(table.limit(0)).columns == COLUMNS
