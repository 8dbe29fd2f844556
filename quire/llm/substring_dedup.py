"""Substring deduplication behind a Count-min prefilter.

Pass 1 sketches, pass 2 groups exactly, pass 3 cuts.

1. Every input partition counts its word windows in a Count-min sketch. A window's key in the sketch is its minimiser, the
   smallest hash of its seven-word runs: equal windows have equal minimisers, so of a window in two texts the key counts
   two at least, and neighbouring windows of a text share keys and count once, which makes the sketch four times smaller. The sketches are
   merged, shard by shard, and only one bit per cell, "two or more", is broadcast: ``3 * 2**bits`` bits, at most 96 MB at
   the default ``max_bits``.
2. Windows estimated to repeat are grouped by 96 bits of hash, exactly. Within a chunk of a task, all but the smallest
   document of a window are settled at once, and a task remembers common windows from chunk to chunk, so such a window
   reaches the exchange a few times per task, however often it occurs.
3. Covered words leave their documents.

The sketch only ever overestimates, so a too small one costs exchange volume, never results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import CHUNK, WINDOW_BASES, binary_view, fmix, input_bytes, inside, lean, rolled, row_chunks, trimmed, whole_text, word_hashes

ROWS = 3
SHARD_BITS = 20
#: Minimisers that a task gathers before it ships a part of its sketch.
FLUSH = 1 << 19
#: Rows of a batch that leaves a worker.
SHIP = 1 << 16
#: Rows of a chunk from which a window counts as common, and windows so remembered by a task at most: both bound traffic only.
COMMON, KNOWN = 64, 1 << 16
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def minimisers(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each run of ``window`` words the smallest hash of its runs of ``anchor`` words."""
    runs = rolled(hashes, anchor, WINDOW_BASES[0])
    span = window - anchor + 1
    n = len(runs) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out = 1, runs
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out[:n]


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return fmix(keys ^ SEEDS[row]) >> np.uint64(64 - bits)


def _sketches(batches: Iterator[pa.RecordBatch], window: int, anchor: int, bits: int) -> Iterator[pa.RecordBatch]:
    low = min(bits, SHARD_BITS)
    pack = zstandard.ZstdCompressor(level=1)

    def shipped(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(parts)
        for row in range(ROWS):
            found, count = np.unique(cells(keys, row, bits), return_counts=True)
            shard = (found >> np.uint64(low)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blobs, names = [], []
            for a, b in zip(cuts, np.r_[cuts[1:], len(found)]):
                offset = (found[a:b] & np.uint64((1 << low) - 1)).astype(np.uint32)
                # the gap to the next cell, and in the lowest bit whether the cell was hit more than once here
                gaps = np.diff(offset, prepend=np.uint32(0)) * 2 + (count[a:b] > 1)
                blobs.append(pack.compress(gaps.astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes()))
                names.append((row << 32) | int(shard[a]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "cells"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            hashes, first = word_hashes(*binary_view(part.column("bytes")))
            where, owner = inside(first, window)
            if not len(where):
                continue
            keys = minimisers(hashes, window, anchor)[where]
            fresh = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
            held.append(keys[fresh])
            size += len(held[-1])
            if size >= FLUSH:
                yield from shipped(held)
                held, size = [], 0
    if size:
        yield from shipped(held)


def _merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Adds up the sketches of one shard after another; they come sorted by shard."""
    size = 1 << min(bits, SHARD_BITS)
    unpack = zstandard.ZstdDecompressor()
    now, total = None, np.zeros(size, np.uint8)

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["shard", "bits"])

    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("cells").to_pylist()):
            if shard != now:
                if now is not None:
                    yield closed()
                now, total = shard, np.zeros(size, np.uint8)
            raw = np.frombuffer(unpack.decompress(blob), np.uint8)
            gaps = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)
            at = np.cumsum(gaps >> 1)
            total[at] = np.minimum(total[at] + 1 + (gaps & 1).astype(np.uint8), 2)
    if now is not None:
        yield closed()


def repeated_cells(texts: DataFrame, window: int, anchor: int, bits: int) -> np.ndarray:
    """One bit per cell of the merged sketch: whether its count is two or more. Rows of ``texts``: bytes."""
    low = min(bits, SHARD_BITS)
    parts = texts.mapInArrow(lambda it: trimmed(_sketches(it, window, anchor, bits)), "shard long, cells binary")
    shards = ROWS << (bits - low)
    # an explicit count: the shards are few, and a task should hold more than one at most in turn
    merged = parts.repartition(min(shards, 64), "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _merged(it, bits), "shard long, bits binary")
    out = np.zeros((ROWS, max(1, (1 << bits) // 8)), np.uint8)
    width = max(1, (1 << low) // 8)
    for row in merged.toLocalIterator():
        at = (row["shard"] & 0xFFFFFFFF) * width
        out[row["shard"] >> 32, at : at + width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _candidates(batches: Iterator[pa.RecordBatch], window: int, anchor: int, bits: int, sketch, coded: bool) -> Iterator[pa.RecordBatch]:
    table = np.frombuffer(sketch.value, np.uint8).reshape(ROWS, -1)
    names = ["h1", "h2", "doc_id", "place"] + ["text_hash"] * coded

    def resolved(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, code, pos = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, code, pos = (x[order] for x in (h1, h2, doc, code, pos))
        head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        at = np.flatnonzero(head)
        least = doc[at]
        n = np.diff(np.r_[at, len(doc)])
        if len(known[0]):
            spot = np.minimum(np.searchsorted(known[0], h1[at]), len(known[0]) - 1)
            before = np.where((known[0][spot] == h1[at]) & (known[1][spot] == h2[at]), known[2][spot], np.iinfo(np.int64).max)
            least = np.minimum(least, before)
        else:
            spot, before = np.zeros(len(at), np.int64), np.full(len(at), np.iinfo(np.int64).max)
        old = before < np.iinfo(np.int64).max
        known[2][spot[old]] = least[old]
        fresh = np.flatnonzero((n >= COMMON) & ~old)
        if len(fresh) and len(known[0]) < KNOWN:
            both = [np.r_[k, x] for k, x in zip(known, (h1[at[fresh]], h2[at[fresh]], least[fresh]))]
            _, one = np.unique(both[0], return_index=True)
            known[:] = [b[one] for b in both]
        # what the task has sent before speaks for the smallest document; rows of that document itself go on
        gone = doc > np.repeat(least, n)
        # of the smallest document itself one row is enough, unless its id or the window occurs there again
        for settled in (False, True):
            take = np.flatnonzero(gone == settled)
            if not len(take):
                continue
            if settled:
                take = take[np.lexsort((pos[take], code[take], doc[take]))]
                d, c, p = doc[take], code[take], pos[take]
                # settled windows travel as runs, with their number; for the others it is 0
                new = np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)]
                at = np.flatnonzero(new)
                take, length = take[at], np.diff(np.r_[at, len(new)])
            else:
                length = np.zeros(len(take), np.int64)
            columns = [h1[take].view(np.int64), h2[take].view(np.int32), doc[take], (length << 32) | pos[take]] + [code[take]] * coded
            rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            for low in range(0, rows.num_rows, SHIP):
                yield rows.slice(low, SHIP)

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    # windows common in this task, with the smallest document that it has sent for each: later rows of others are settled
    known = [np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)]
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            hashes, first = word_hashes(*binary_view(part.column("bytes")))
            where, owner = inside(first, window)
            if not len(where):
                continue
            keys = minimisers(hashes, window, anchor)
            likely = np.ones(len(keys), bool)
            for row in range(ROWS):
                cell = cells(keys, row, bits)
                likely &= (table[row][cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
            take = likely[where]
            where, owner = where[take], owner[take]
            ids, codes = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("text_hash").to_numpy(zero_copy_only=False)
            held.append((rolled(hashes, window, WINDOW_BASES[0])[where], (rolled(hashes, window, WINDOW_BASES[1])[where] >> np.uint64(32)).astype(np.uint32), ids[owner], codes[owner], where - first[owner]))
            size += len(where)
            if size >= FLUSH:
                yield from resolved(held)
                held, size = [], 0
    if size:
        yield from resolved(held)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_text", "removed", "rest"]
    for batch in batches:
        for part in row_chunks(batch, "bytes", CHUNK):
            n_words, n_removed, kept, removed = [], [], [], []
            for raw, spans in zip(part.column("bytes"), part.column("spans")):
                words = raw.as_py().split()
                n_words.append(len(words))
                if not spans.is_valid:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    removed.append([])
                    continue
                spans = spans.values
                low = spans.field("first").to_numpy()
                high = low + spans.field("n").to_numpy() + window - 1
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, low, 1)
                np.add.at(delta, high, -1)
                gone = np.cumsum(delta[:-1]) > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                removed.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), part.column("rest")], names
            )


def substring_dedup(docs: DataFrame, window: int = 13, anchor: int = 7, max_bits: int = 28, bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes from each document the words covered by a window that also starts in a document with a smaller doc_id.

    Returns one row per row of ``docs`` (columns used: doc_id, text; others are ignored): doc_id, n_words, n_removed,
    kept_text (kept words joined by one space), removed (spans of word indexes, end exclusive) and, if columns to ``carry``
    are named, rest, a struct of them. Windows are judged on
    the input. Null and empty texts have no words; a text of fewer words than a window keeps all. Rows with equal
    doc_id never remove words from each other, and each is returned. Rows with a null doc_id are kept whole and remove
    nothing. ``bits`` is the base-two logarithm of the sketch's width; by default it follows the input's size, up to
    ``max_bits``.
    """
    bits = bits or max(12, min(max_bits, math.ceil(math.log2(max(2, input_bytes(docs)))) - 2))
    rest = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    # only where ids repeat does a row need its text's hash to be told from others
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count()
    code = F.xxhash64("text") if twice else F.lit(0).cast("long")
    row = ["doc_id", "text_hash"] if twice else ["doc_id"]
    texts = lean(docs).select("doc_id", whole_text().alias("bytes"), code.alias("text_hash"), rest.alias("rest"))
    seen = texts.where(F.col("doc_id").isNotNull()).select("doc_id", "bytes", "text_hash")
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(seen.select("bytes"), window, anchor, bits).tobytes())
    coded = bool(twice)
    schema = "h1 long, h2 int, doc_id long, place long" + ", text_hash long" * coded
    found = seen.mapInArrow(lambda it: trimmed(_candidates(it, window, anchor, bits, sketch, coded)), schema)
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    # a place is a word's number and above it, of runs that are settled, their number of windows
    doomed = found.withColumn("least", least).where((F.col("place") >= 1 << 32) | (F.col("doc_id") > F.col("least")))
    span = F.struct(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("first"), F.greatest(F.shiftright("place", 32).cast("int"), F.lit(1)).alias("n"))
    spans = doomed.groupBy(*row).agg(F.collect_list(span).alias("spans"))
    joined = texts.join(spans, row, "left").select("doc_id", "bytes", "spans", "rest")
    schema = f"doc_id long, n_words long, n_removed long, kept_text binary, removed array<struct<first:int,end:int>>, rest {joined.schema['rest'].dataType.simpleString()}"
    out = joined.mapInArrow(lambda it: trimmed(_cut(it, window)), schema)
    return out.withColumn("kept_text", F.col("kept_text").cast("string")).drop(*([] if carry else ["rest"]))


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
