"""Centroid clustering of integer vectors: blocked float64 products, exact at every magnitude.

Squared distances are expanded as |x|^2 - 2 x.c + |c|^2, so that a block of vectors meets all centroids in one matrix product.
Vectors are integers: while ``width * (largest |x| + largest |c|)**2`` stays below 2**53, every product and partial sum is an
integer that a double holds exactly, in whatever order BLAS adds. A block beyond that bound is computed in 64-bit integers, one
beyond 2**63 in Python's integers. Sums of a cluster's vectors are products too, of the block's assignment matrix with the
block, under the same kind of bound.

Each input partition adds up its blocks and sends one row; ``treeAggregate`` combines the rows, so a round moves
``k * (width + 2)`` integers a partition and nothing of the vectors themselves.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import lean, trimmed

CENTROIDS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Vectors of a block: 2 MB of doubles at 64 components.
BLOCK = 4096
DOUBLE, LONG = 1 << 53, 1 << 63


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite floats: in 64 bits where they suffice, else as Python's integers."""
    x = x.astype(np.float64)
    if np.abs(x).max(initial=0) * scale < DOUBLE:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= DOUBLE else math.floor(v * scale)  # noqa: E731  doubles that large are whole
    return np.array([whole(float(v)) for v in x.ravel()], object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def kind_for(bound: int) -> type:
    """The fastest kind of number that is exact up to the bound."""
    return np.float64 if bound < DOUBLE else np.int64 if bound < LONG else object


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid, ties to the smaller one, and the squared distance."""
    kind = kind_for(x.shape[1] * (largest(x) + largest(centroids)) ** 2)
    a, c = x.astype(kind), centroids.astype(kind)
    away = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
    chosen = away.argmin(axis=1)
    distance = away[np.arange(len(x)), chosen]
    return chosen, distance if kind is object else distance.astype(np.int64)


def summed(x: np.ndarray, chosen: np.ndarray, k: int) -> list[list[int]]:
    """Componentwise sums of the rows of each cluster, as Python's integers."""
    kind = kind_for(len(x) * largest(x))
    member = (chosen[None, :] == np.arange(k)[:, None]).astype(kind)
    return [[int(v) for v in row] for row in member @ x.astype(kind)]


def blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            yield part, integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def added(a: list | None, b: list | None) -> list | None:
    """Two totals of (count, inertia, sums) a cluster."""
    if a is None or b is None:
        return a if b is None else b
    return [[n + m, i + j, [x + y for x, y in zip(s, t)]] for (n, i, s), (m, j, t) in zip(a, b)]


def _totals(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, width: int, scale: int) -> Iterator[pa.RecordBatch]:
    k, total = len(centroids), None
    for _, x in blocks(batches, width, scale):
        chosen, distance = nearest(x, centroids)
        count = np.bincount(chosen, minlength=k)
        # a distance that 64 bits hold may still overflow when summed
        inertia = [0] * k
        if distance.dtype != object and largest(distance) * len(distance) < LONG:
            per = np.zeros(k, np.int64)
            np.add.at(per, chosen, distance)
            inertia = per.tolist()
        else:
            for c, d in zip(chosen.tolist(), distance.tolist()):
                inertia[c] += d
        total = added(total, [[int(n), i, s] for n, i, s in zip(count, inertia, summed(x, chosen, k))])
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)])], ["total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, inertia: list[int], width: int, scale: int) -> Iterator[pa.RecordBatch]:
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda v: v if v < LONG else None
    own, whole = [fits(i) for i in inertia], fits(sum(inertia))
    for part, x in blocks(batches, width, scale):
        chosen, distance = nearest(x, centroids)
        chosen = chosen.tolist()
        yield pa.RecordBatch.from_arrays(
            [part.column("vec_id"), pa.array(chosen, pa.int32()), pa.array([fits(d) for d in distance.tolist()], pa.int64()), pa.array([own[c] for c in chosen], pa.int64()), pa.array([whole] * len(x), pa.int64()), pa.array([prints[c] for c in chosen])],
            ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        )


def totals(vectors: DataFrame, centroids: np.ndarray, width: int = WIDTH, scale: int = SCALE) -> list:
    """(count, inertia, sums) of each centroid's vectors, combined in a tree."""
    parts = vectors.mapInArrow(lambda it: trimmed(_totals(it, centroids, width, scale)), "total string")
    total = parts.rdd.treeAggregate(None, lambda a, row: added(a, json.loads(row.total)), added)
    return total or [[0, 0, [0] * width] for _ in centroids]


def moved(centroids: np.ndarray, total: list) -> np.ndarray:
    """Each centroid that has vectors goes to the floor of their mean."""
    rows = [[s // n for s in sums] if n else list(old) for old, (n, _, sums) in zip(centroids.tolist(), total)]
    kind = np.int64 if max((abs(v) for r in rows for v in r), default=0) < LONG else object
    return np.array(rows, kind)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector that takes part.

    Vectors of exactly ``width`` components, none null or non-finite, take part, as floor(scale * x). Centroids start as the
    ``k`` vectors whose ids have the smallest SHA-256 of "1:<vec_id>" (of repeated ids, the smaller vector first; all, if
    fewer). Each round assigns every vector to the nearest centroid, ties to the smaller number, and moves every centroid
    with vectors to the floor of their mean; then vectors are assigned once more. Repeated rows count each; rows with a null
    vec_id take part but don't start a centroid (if no row has an id, there are no centroids and no rows). No vectors, no
    rows. Distances and inertias beyond 64 bits are null; they count exactly all the same. Columns used: vec_id, embedding.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lean(vectors).where((F.size("embedding") == width) & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = whole.where("vec_id is not null").orderBy(order, "embedding").limit(k).collect()
    if not first:
        return whole.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    centroids = integers(np.array([r.embedding for r in first]), scale)
    for _ in range(rounds):
        centroids = moved(centroids, totals(whole, centroids, width, scale))
    inertia = [i for _, i, _ in totals(whole, centroids, width, scale)]
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return whole.mapInArrow(lambda it: trimmed(_assigned(it, centroids, inertia, width, scale)), out)


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out one after another."""
    near = "SELECT vec_id, v, n, d FROM (SELECT vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), n) AS r FROM v, c{0}) WHERE r = 1"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS n, v AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(r)})",
            f"m{r} AS (SELECT n, list(q ORDER BY i) AS c FROM (SELECT n, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS q FROM (SELECT n, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY n, i) GROUP BY n)",
            f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (n))",
        ]
    steps.append(f"a AS MATERIALIZED ({near.format(ROUNDS)})")
    return f"""
WITH {', '.join(steps)}
SELECT vec_id, n::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} USING (n)
"""


#: Three rounds over all pairs of vectors and centroids; for tables whose ids are unique.
SQL = _sql()
