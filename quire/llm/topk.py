"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors in order of their ids form blocks with a forward index (the vectors themselves, as integers) and, for each
component, the largest and smallest value. A query's bound for a block is the sum over components of the larger of its
products with the two. Each query starts from a floor that all tasks share, its k-th best score over the blocks of a fixed
number of places spread over the ids, takes the blocks of a shelf (up to SHELF of them) in falling order of bound, and
stops when the bound is below its k-th score.

Queries are a table like the vectors: groups of up to QUERIES of them meet each shelf in a task of its own, so neither side
passes through the driver, and a task holds one group and one shelf. Each sends ``k`` rows a query on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import lean, trimmed, written

#: Vectors of a block, blocks of a shelf, queries of a group, blocks that floors are taken from (4 MB at 64 components).
BLOCK, SHELF, QUERIES, SEEDS = 128, 64, 4096, 64
#: Partitions that cells are dealt to at most.
MOST = 10_000
CELL = "g int, s int, kind int, number long, ids binary, vectors binary, high binary, low binary"


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; missing components are nought."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy()
    return out


def slim(x: np.ndarray) -> bytes:
    """Two bytes a value where that is enough: then one byte in front says so."""
    small = np.abs(x).max(initial=0) < 1 << 15
    return (b"\2" if small else b"\x08") + x.astype("<i2" if small else "<i8").tobytes()


def unslim(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, "<i2" if x[0] == 2 else "<i8", offset=1).astype(np.int64).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of up to BLOCK vectors: smallest id, ids, vectors (vector by component), largest and smallest components."""
    for batch in batches:
        rows = []
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            ids, vectors = part.column("vec_id").to_numpy(), matrix(part.column("v"), width)
            rows.append((int(ids[0]), ids.astype("<i8").tobytes(), slim(vectors), slim(vectors.max(axis=0)), slim(vectors.min(axis=0))))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["number", "ids", "vectors", "high", "low"])


def merged(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of rows of (query, id, score) each query's k best, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], scores[keep]


def best(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, ...]], k: int, floor: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """Rows of (query, id, score), each query's k best of blocks of (ids, vectors, high, low) among scores at or above its
    floor, and how many times a query was held against a block."""
    high, low = (np.stack([b[i] for b in blocks]) for i in (2, 3))
    top = max(int(np.abs(x).max(initial=0)) for x in (queries, high, low))
    # sums of products of such size are exact in doubles, and doubles are faster
    kind = float if top * top * queries.shape[1] < 1 << 53 else np.int64
    q, floor = queries.astype(kind), floor.astype(kind)
    bound = np.maximum(q, 0) @ high.T.astype(kind) + np.minimum(q, 0) @ low.T.astype(kind)
    order = np.argsort(-bound, axis=1, kind="stable")
    least = -np.inf if kind is float else np.iinfo(np.int64).min
    none = np.zeros(0, np.int64)
    have, met = (none, none, none), 0
    live = np.arange(len(q))
    for rank in range(len(blocks)):
        live = live[bound[live, order[live, rank]] >= floor[live]]
        if not len(live):
            break
        met += len(live)
        chosen = order[live, rank]
        found = [have]
        for b in np.unique(chosen):
            rows = live[chosen == b]
            ids, vectors = blocks[b][0], blocks[b][1]
            scores = q[rows] @ vectors.T.astype(kind)
            # a query's own rows take no place among the block's k best
            own = ids[None, :] == query_ids[rows][:, None]
            scores[own] = least
            hit = (scores >= floor[rows][:, None]) & ~own
            if scores.shape[1] > k:
                hit &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
            r, c = np.nonzero(hit)
            found.append((rows[r], ids[c], scores[r, c].astype(np.int64)))
        have = merged(*(np.concatenate(x) for x in zip(*found)), k)
        count = np.bincount(have[0], minlength=len(q))
        full = count == k
        floor[full] = np.maximum(floor[full], have[2][(np.cumsum(count) - 1)[full]])
    return have, met


def _asked(batches: Iterator[pa.RecordBatch], seeds, width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries as rows of (number, ids, vectors) and, as high, the floor: their k-th best score over the seeds."""
    blocks = [(np.frombuffer(ids, "<i8"), unslim(vectors, width), unslim(high, width)[0], unslim(low, width)[0]) for ids, vectors, high, low in seeds.value]
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            ids, vectors = part.column("vec_id").to_numpy(), matrix(part.column("v"), width)
            floor = np.full(len(ids), np.iinfo(np.int64).min)
            if blocks:
                (query, _, score), _ = best(ids, vectors, blocks, k, floor)
                count = np.bincount(query, minlength=len(ids))
                full = count == k
                floor[full] = score[(np.cumsum(count) - 1)[full]]
            columns = [part.column("number"), *(pa.array(list(x), pa.binary()) for x in (map(np.int64.tobytes, ids.astype("<i8")), map(slim, vectors), map(np.int64.tobytes, floor.astype("<i8"))))]
            yield pa.RecordBatch.from_arrays(columns, ["number", "ids", "vectors", "high"])


def _searched(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Cells (g, s) of queries (kind 0) and blocks (kind 1), which come sorted: the k best of each query in each cell."""
    names = ["query", "query_id", "vec_id", "score"]
    now, asked, shelf = None, [], []

    def closed() -> Iterator[pa.RecordBatch]:
        if asked and shelf:
            numbers, ids, floor = np.array([a[0] for a in asked], np.int64), np.concatenate([a[1] for a in asked]), np.concatenate([a[3] for a in asked])
            (query, vec, score), _ = best(ids, np.concatenate([a[2] for a in asked]), shelf, k, floor)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[query], ids[query], vec, score)], names)

    for batch in batches:
        for g, s, kind, number, ids, vectors, high, low in zip(*(c.to_pylist() for c in batch.columns)):
            if (g, s) != now:
                yield from closed()
                now, asked, shelf = (g, s), [], []
            if kind == 0:
                asked.append((number, np.frombuffer(ids, "<i8"), unslim(vectors, width), np.frombuffer(high, "<i8")))
            else:
                shelf.append((np.frombuffer(ids, "<i8"), unslim(vectors, width), unslim(high, width)[0], unslim(low, width)[0]))
    yield from closed()


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the k best other vectors.

    Components count as floor(scale * x); a score is the inner product, of the components that both vectors have; ties go
    to the smaller vec_id. Vectors that are null or hold nulls or non-finite components, and rows with a null vec_id, take
    no part. Rows with a query's own vec_id are never among its results. Repeated query rows count once. Fewer other
    vectors than k: all of them; no vectors, no rows. Columns used: vec_id, embedding.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lean(vectors).where("vec_id is not null and embedding is not null").where(F.coalesce(finite, F.lit(False)))
    ready = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    width = max(1, ready.agg(F.max(F.size("v"))).first()[0] or 1)
    block = "number long, ids binary, vectors binary, high binary, low binary"
    blocks = written(ready.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(lambda it: trimmed(_blocks(it, width)), block))
    n_blocks = blocks.count()
    # blocks at SEEDS places spread over the ids: a bounded number, whatever the table
    spread = blocks.orderBy(F.xxhash64("number"), "number", "ids").limit(SEEDS).select("ids", "vectors", "high", "low").collect()
    seeds = vectors.sparkSession.sparkContext.broadcast([tuple(map(bytes, r)) for r in spread])
    distinct = ready.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.lit(0).alias("_")).select(F.xxhash64("vec_id", "v").alias("number"), "vec_id", "v")
    asked = written(distinct.mapInArrow(lambda it: trimmed(_asked(it, seeds, width, k)), "number long, ids binary, vectors binary, high binary"))
    groups, shelves = max(1, -(-asked.count() // QUERIES)), max(1, -(-n_blocks // SHELF))

    left = asked.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("s"), F.lit(0).alias("kind"), "number", "ids", "vectors", "high", F.lit(None).cast("binary").alias("low"))
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("number", "ids"), F.lit(shelves)).cast("int").alias("s"), F.lit(1).alias("kind"), "number", "ids", "vectors", "high", "low")
    cells = left.unionByName(right).repartition(min(groups * shelves, MOST), "g", "s").sortWithinPartitions("g", "s", "kind", "number", "ids")
    found = cells.mapInArrow(lambda it: trimmed(_searched(it, width, k)), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
