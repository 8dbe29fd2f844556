"""Substring deduplication by longest-previous-factor arrays of suffixes.

A window is a string of ``width`` bytes of one text. Windows in order of their bytes form a suffix array; the longest common
prefixes of neighbours and, for each window, the nearest ones in that order that start earlier in the corpus (previous and next
smaller positions) give its longest previous factor and where that stands. A window whose factor reaches ``width`` is a later
copy; the windows that later copies point at are the first ones.

The array is cut into parts that can't miss a match. A window's anchor is the smallest hash of its runs of ``ANCHOR`` bytes:
equal windows have equal anchors, and neighbouring windows mostly share theirs, so a text falls into segments, runs of
windows of one anchor, and only segments of one anchor need to meet.

1. Each task counts anchors in a Count-min sketch; merged, two bits a cell are broadcast: "two or more" and "HOT or more".
2. Segments of repeated anchors are exchanged by anchor. Equal segments of a task travel once. Of anchors that are
   common beyond HOT, windows travel by 128 bits of hash of their own, equal ones of a task once, so that no anchor makes a large group;
   the earliest of equal windows is the previous factor of the others there.
3. A task takes whole anchors, some hundred KB of segments at a time, sorts their windows and reads the array.
4. Covered bytes leave their texts.

The sketch only ever overestimates: too small a one costs exchange volume, never results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import binary_view, fmix, input_bytes, lean, row_chunks, trimmed, whole_text

WIDTH, ANCHOR = 200, 64
#: Windows of a segment, and places from which an anchor is common: together they bound the segments of an anchor that isn't.
RUN, HOT = 256, 512
#: Windows looked at together: arrays of them stay in a core's cache.
PIECE = 1 << 16
ROWS, SHARD_BITS = 3, 20
#: Anchors, bytes of segments and hot windows that a task gathers before it ships them, and bytes of segments sorted together.
FLUSH, HELD, WINDOWS, TOGETHER = 1 << 19, 8 << 20, 1 << 19, 256 << 10
SEEDS = tuple(np.uint64(s) for s in (0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD))
LEAST = -(1 << 63)


def grams(buf: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` bytes: runs of 8 as they are, longer ones as a tree of halves."""
    power, now, done, out = 1, buf.astype(np.uint64), 0, None
    while True:
        if width & power:
            # the parts from the smallest to the largest, one after another
            out = now if out is None else mixed(out[: len(out) - power], power, seed) + now[done:][: len(out) - power]
            done += power
        if power << 1 > width:
            break
        if power < 8:
            now = now[:-power] << np.uint64(8 * power) | now[power:]
        else:
            now = mixed(now[:-power], power, seed) + now[power:]
        power <<= 1
    return fmix(out + np.uint64(seed))


def mixed(x: np.ndarray, level: int, seed: int) -> np.ndarray:
    """A finaliser of its own for each level and seed: every bit of what goes in tells on every bit of what comes out, and hashes of two
    seeds have nothing in common."""
    own = int(fmix(np.array([(seed << 32) + level], np.uint64))[0]) | 1
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(own)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def slid(x: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``span`` values."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


def segments(buf: np.ndarray, at: np.ndarray, width: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Piece by piece: the hash at each place that is some window's anchor; and the runs of windows of one text and anchor:
    anchors, texts, first windows (in ``buf``), numbers of windows and whether the anchor has several places in the piece."""
    long = np.flatnonzero(np.diff(at) >= width)
    begin, end = at[long], at[long + 1] - width + 1
    span = width - anchor + 1
    for low in range(0, max(0, len(buf) - width + 1), PIECE):
        high = min(low + PIECE, len(buf) - width + 1)
        a, b = np.searchsorted(end, low, "right"), np.searchsorted(begin, high)
        if a == b:
            continue
        hashes = grams(buf[low : high + width - 1], anchor)
        keys = slid(hashes, span, np.minimum)
        edge = np.r_[True, keys[1:] != keys[:-1]]
        lo, hi = np.maximum(begin[a:b], low) - low, np.minimum(end[a:b], high) - low
        edge[lo] = True
        inside = np.zeros(high - low + 1, np.int8)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        inside = np.cumsum(inside[:-1]) > 0
        edge[hi[hi < len(edge)]] = True
        first = np.flatnonzero(edge)
        n = np.diff(np.r_[first, high - low])
        first, n = first[inside[first]], n[inside[first]]
        # of the windows around a place none has a smaller hash where the largest of their anchors is that place's
        own = np.zeros(len(keys) + 2 * (span - 1), np.uint64)
        own[span - 1 : span - 1 + len(keys)] = np.where(inside, keys, np.uint64(0))
        places = hashes[slid(own, span, np.maximum) == hashes]
        values, count = np.unique(places, return_counts=True)
        # runs of repeated characters have one anchor throughout
        parts = -(-n // RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + step * RUN, np.minimum(np.repeat(n, parts) - step * RUN, RUN)
        several = count[np.searchsorted(values, keys[first])] > 1
        yield places, keys[first], long[np.searchsorted(begin, first + low, "right") - 1], first + low, n, several


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return fmix(keys ^ SEEDS[row]) >> np.uint64(64 - bits)


def _sketches(batches: Iterator[pa.RecordBatch], width: int, anchor: int, bits: int) -> Iterator[pa.RecordBatch]:
    low = min(bits, SHARD_BITS)
    pack = zstandard.ZstdCompressor(level=1)

    def shipped() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        for row in range(ROWS):
            found, count = np.unique(cells(keys, row, bits), return_counts=True)
            shard = (found >> np.uint64(low)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            names, blobs = [], []
            for a, b in zip(cuts, np.r_[cuts[1:], len(found)]):
                gaps = np.diff((found[a:b] & np.uint64((1 << low) - 1)).astype("<u4"), prepend=np.uint32(0))
                planes = [gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), np.minimum(count[a:b], HOT).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()]
                names.append(row << 32 | int(shard[a]))
                blobs.append(pack.compress(b"".join(planes)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "cells"])

    held, size = [], 0
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            for places, *_ in segments(*binary_view(part.column("bytes")), width, anchor):
                held.append(places)
                size += len(places)
            if size >= FLUSH:
                yield from shipped()
                held, size = [], 0
    if size:
        yield from shipped()


def _merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Adds up one shard after another, sorted by shard: a bit a cell for "two or more", then one for "HOT or more"."""
    unpack = zstandard.ZstdDecompressor()
    now, total = None, np.zeros(1 << min(bits, SHARD_BITS), np.uint32)

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= 2).tobytes() + np.packbits(total >= HOT).tobytes()], pa.binary())], ["shard", "bits"])

    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("cells").to_pylist()):
            if shard != now:
                if now is not None:
                    yield closed()
                now = shard
                total[:] = 0
            raw = np.frombuffer(unpack.decompress(blob), np.uint8)
            n = len(raw) // 6
            gaps, count = (np.ascontiguousarray(x.reshape(k, n).T).view(f"<u{k}").reshape(-1) for k, x in ((4, raw[: 4 * n]), (2, raw[4 * n :])))
            spot = np.cumsum(gaps)
            total[spot] = np.minimum(total[spot] + count, HOT)
    if now is not None:
        yield closed()


def sketch(texts: DataFrame, width: int, anchor: int, bits: int) -> np.ndarray:
    """Two bits a cell of the merged sketch, as [what, row, byte]. Rows of ``texts``: bytes."""
    low = min(bits, SHARD_BITS)
    parts = texts.mapInArrow(lambda it: trimmed(_sketches(it, width, anchor, bits)), "shard long, cells binary")
    shards = ROWS << (bits - low)
    merged = parts.repartition(min(shards, 64), "shard").sortWithinPartitions("shard").mapInArrow(lambda it: trimmed(_merged(it, bits)), "shard long, bits binary")
    each = max(1, (1 << low) // 8)
    out = np.zeros((2, ROWS, max(1, (1 << bits) // 8)), np.uint8)
    for row in merged.toLocalIterator():
        at = (row["shard"] & 0xFFFFFFFF) * each
        out[:, row["shard"] >> 32, at : at + each] = np.frombuffer(row["bits"], np.uint8).reshape(2, each)
    return out


#: SETTLED rows are results already: windows that a task saw to be copies. ``known`` rows only tell others of their bytes.
SETTLED, SEGMENT, WINDOW = 0, 1, 2
FIELDS = [("h", pa.int64()), ("kind", pa.int32()), ("h2", pa.int64()), ("doc", pa.int64()), ("code", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("known", pa.bool_()), ("bytes", pa.binary())]
SHIPPED = "h long, kind int, h2 long, doc long, code long, start int, n int, known boolean, bytes binary"


def batch_of(kind: int, h, h2, doc, code, start, n, known, blobs=None) -> pa.RecordBatch:
    size = len(doc)
    fill = lambda x: np.full(size, x) if np.isscalar(x) else x
    columns = [fill(h), fill(kind), fill(h2), doc, code, start, fill(n), fill(known), blobs if blobs is not None else [None] * size]
    return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, list) else np.asarray(c).astype(k.to_pandas_dtype() if k != pa.binary() else object), k) for c, (_, k) in zip(columns, FIELDS)], [name for name, _ in FIELDS])


def settled(doc: np.ndarray, code: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Result rows, dealt by their place."""
    return batch_of(SETTLED, fmix(doc.view(np.uint64) ^ fmix(start.astype(np.uint64))).view(np.int64), 0, doc, code, start, n, True)


def runs(doc: np.ndarray, code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of texts as runs of neighbours."""
    order = np.lexsort((start, code, doc))
    doc, code, start = doc[order], code[order], start[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (start[1:] > start[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    last = np.r_[head[1:], len(doc)] - 1
    return doc[head], code[head], start[head], start[last] - start[head] + 1 if len(head) else start


def _shipped(batches: Iterator[pa.RecordBatch], width: int, anchor: int, bits: int, table, first: bool) -> Iterator[pa.RecordBatch]:
    """Segments of repeated anchors, windows of common ones, and what is settled within the task."""
    often, common = np.frombuffer(table.value, np.uint8).reshape(2, ROWS, -1)
    held: dict[bytes, list] = {}
    windows: list[tuple[np.ndarray, ...]] = []
    size = n_windows = 0

    def hit(which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            cell = cells(keys, row, bits)
            out &= (which[row][cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return out

    def segments_out() -> Iterator[pa.RecordBatch]:
        """Of equal segments the first one; the others are settled, and it too unless first ones stay."""
        rows, done = [], []
        for blob, (h, inner, places) in held.items():
            places.sort()
            copies = places[1:] if first else places
            if len(places) > 1:
                done += [(*p, len(blob) - width + 1) for p in copies]
            rows.append((h, inner, *places[0], len(blob) - width + 1, len(places) > 1 and not first, blob))
        for low in range(0, len(rows), 4096):
            h, inner, doc, code, start, n, known, blobs = map(list, zip(*rows[low : low + 4096]))
            yield batch_of(SEGMENT, np.array(h, np.uint64).view(np.int64), np.array(inner), np.array(doc), np.array(code), np.array(start), np.array(n), np.array(known), blobs)
        if done:
            doc, code, start, n = (np.array(x, np.int64) for x in zip(*done))
            yield settled(doc, code, start, n)

    def windows_out() -> Iterator[pa.RecordBatch]:
        w1, w2, doc, code, start = (np.concatenate(x) for x in zip(*windows))
        order = np.lexsort((start, code, doc, w2, w1) if first else (w2, w1))
        w1, w2, doc, code, start = (x[order] for x in (w1, w2, doc, code, start))
        head = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        again = ~head | np.r_[~head[1:], False]
        yield batch_of(WINDOW, w1[head].view(np.int64), w2[head].view(np.int64), doc[head], code[head], start[head], 1, again[head] & (not first))
        gone = ~head if first else again
        if gone.any():
            yield settled(*runs(doc[gone], code[gone], start[gone]))

    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            buf, at = binary_view(part.column("bytes"))
            doc, code = (part.column(c).to_numpy() for c in ("doc", "code"))
            for _, keys, owner, begin, n, several in segments(buf, at, width, anchor):
                take = np.flatnonzero(hit(often, keys))
                hot = hit(common, keys[take])
                for i in take[~hot].tolist():
                    a = int(begin[i])
                    blob = buf[a : a + int(n[i]) + width - 1].tobytes()
                    own = int(owner[i])
                    place = (int(doc[own]), int(code[own]), a - int(at[own]))
                    if blob in held:
                        held[blob][2].append(place)
                    else:
                        held[blob] = [keys[i], bool(several[i]), [place]]
                        size += len(blob)
                    size += 100
                take = take[hot]
                if not len(take):
                    continue
                # hot segments end to end; windows that would run from one into the next are left out
                reach = n[take] + width - 1
                spot = np.repeat(begin[take] - np.r_[0, np.cumsum(reach)[:-1]], reach) + np.arange(reach.sum())
                joined = buf[spot]
                inner = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) < np.repeat(n[take], reach)
                inner = np.flatnonzero(inner)
                own = np.repeat(owner[take], n[take])
                windows.append((grams(joined, width, 1)[inner], grams(joined, width, 2)[inner], doc[own], code[own], spot[inner] - at[own]))
                n_windows += len(inner)
            if size >= HELD:
                yield from segments_out()
                held, size = {}, 0
            if n_windows >= WINDOWS:
                yield from windows_out()
                windows, n_windows = [], 0
    if held:
        yield from segments_out()
    if windows:
        yield from windows_out()


def suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte strings, and of each in that order the longest common prefix with the one before."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").reshape(-1), kind="stable")
    near = rows[order]
    differ = near[1:] != near[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if len(near) > 1 else np.zeros(0, np.int64)
    return order, np.r_[np.zeros(min(1, len(near)), np.int64), common]


def previous_factors(common: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """For strings in their order, the nearest before and after in that order with a smaller position (-1: none), and the
    longest common prefix with each; the larger of the two is the string's longest previous factor."""
    n = len(position)
    before, after = [-1] * n, [-1] * n
    with_before, with_after = [0] * n, [0] * n
    stack: list[tuple[int, int, int]] = []
    for k, (p, m) in enumerate(zip(position.tolist(), common.tolist())):
        while stack and stack[-1][1] > p:
            j, _, least = stack.pop()
            after[j], with_after[j] = k, m
            m = min(m, least)
        if stack:
            before[k], with_before[k] = stack[-1][0], m
        stack.append((k, p, m))
    return tuple(np.array(x, np.int64) for x in (before, with_before, after, with_after))


def repeats(rows: np.ndarray, position: np.ndarray, first: bool) -> np.ndarray:
    """Which strings have an earlier equal; unless ``first`` ones stay, also those that a later equal points at."""
    order, common = suffixes(rows)
    before, with_before, after, with_after = previous_factors(common, position[order])
    width = rows.shape[1]
    out = np.zeros(len(rows), bool)
    out[order] = np.maximum(with_before, with_after) >= width
    if not first:
        for other, reach in ((before, with_before), (after, with_after)):
            out[order[other[reach >= width]]] = True
    return out


def _matched(batches: Iterator[pa.RecordBatch], width: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Spans (doc, code, start, n) of windows to remove; rows come sorted by (h, kind, h2, doc, code, start)."""
    names = ["doc", "code", "start", "n"]

    def out(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)

    def alike(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A chunk of segments of whole anchors: (h, doc, code, start, n, known, bytes, inner); inner ones may repeat within."""
        kept: dict[bytes, list[tuple]] = {}
        for row in group:
            kept.setdefault(row[6], []).append(row)
        gone = []
        for rows in kept.values():
            # equal segments: the first one stands for all
            rows.sort(key=lambda r: r[1:4])
            if len(rows) > 1:
                gone += [r[1:5] for r in (rows[1:] if first else rows) if not r[5]]
        firsts = [rows[0] for rows in kept.values()]
        each = np.array([r[0] for r in firsts], np.int64)
        _, which, count = np.unique(each, return_inverse=True, return_counts=True)
        firsts = [r for r, c in zip(firsts, count[which]) if c > 1 or r[7]]
        if gone:
            yield out(*zip(*gone))
        if not firsts:
            return
        joined = np.frombuffer(b"".join(r[6] for r in firsts), np.uint8)
        n = np.array([r[4] for r in firsts], np.int64)
        reach = n + width - 1
        owner = np.repeat(np.arange(len(firsts)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, code, start = (np.array([r[i] for r in firsts], np.int64)[owner] for i in (1, 2, 3))
        position = np.empty(len(owner), np.int64)
        position[np.lexsort((start + step, code, doc))] = np.arange(len(owner))
        spot = np.repeat(np.cumsum(reach) - reach, n) + step
        found = repeats(np.lib.stride_tricks.sliding_window_view(joined, width)[spot], position, first)
        if found.any():
            yield out(*runs(doc[found], code[found], (start + step)[found]))

    group: list[tuple] = []
    size, now, last = 0, None, None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        done = batch.filter(pa.array(kinds == SETTLED))
        if done.num_rows:
            yield done.select(names)
        for row in zip(*(batch.filter(pa.array(kinds == SEGMENT)).column(c).to_pylist() for c in ("h", "doc", "code", "start", "n", "known", "bytes", "h2"))):
            if row[0] != now and size >= TOGETHER:
                yield from alike(group)
                group, size = [], 0
            now = row[0]
            group.append(row)
            size += len(row[6])
        part = batch.filter(pa.array(kinds == WINDOW))
        if part.num_rows:
            h, h2, doc, code, start = (part.column(c).to_numpy() for c in ("h", "h2", "doc", "code", "start"))
            known = part.column("known").to_numpy(zero_copy_only=False)
            # the row before the batch may begin a group that goes on here
            h, h2, doc, code, start, known = (np.r_[[x], y] if last else y for x, y in zip(last or [0] * 6, (h, h2, doc, code, start, known)))
            same = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
            later, head = np.r_[False, same], np.r_[same, False]
            gone = (later | (False if first else head)) & ~known
            if gone.any():
                yield out(*runs(doc[gone], code[gone], start[gone]))
            # what is reported counts as known from here on
            last = (h[-1], h2[-1], doc[-1], code[-1], start[-1], bool(known[-1] or gone[-1]))
    if group:
        yield from alike(group)


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed", "rest"]
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            n_removed, kept, removed = [], [], []
            for raw, spans in zip(part.column("bytes"), part.column("spans")):
                raw = raw.as_py()
                if not spans.is_valid:
                    n_removed.append(0)
                    kept.append(raw)
                    removed.append([])
                    continue
                low = spans.values.field("start").to_numpy().astype(np.int64)
                high = low + spans.values.field("n").to_numpy() + width - 1
                order = np.argsort(low)
                low, reach = low[order], np.maximum.accumulate(high[order])
                head = np.flatnonzero(np.r_[True, low[1:] > reach[:-1]])
                begin, end = low[head], reach[np.r_[head[1:], len(low)] - 1]
                n_removed.append(int((end - begin).sum()))
                removed.append([{"first": int(a), "end": int(b)} for a, b in zip(begin, end)])
                kept.append(b"".join(raw[a:b] for a, b in zip(np.r_[0, end], np.r_[begin, len(raw)])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(r) for r in part.column("bytes").to_pylist()], pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), part.column("rest")], names
            )


def suffix_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, keep: str = "first", max_bits: int = 27, bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes from each text the bytes covered by a ``width``-byte string that starts elsewhere too.

    With ``keep`` "first" only strings that start earlier as well count, so that the first copy stays (texts by doc_id, null
    first, then by their hash; positions within a text); with "none" all copies go. One row per row of ``docs`` (columns used:
    doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes: a cut may fall within a
    character), removed (byte spans, end exclusive) and, if columns to ``carry`` are named, rest, a struct of them. Matches
    never cross texts; overlapping ones count; strings are judged on the input. Null and empty texts, and those shorter than
    ``width``, lose nothing. Rows with equal or null ids are texts like others; of
    rows alike in id and text none is the first, all go. ``bits`` is the base-two logarithm of the sketch's width; by default
    it follows the input's size, up to ``max_bits``. No rows, no result.
    """
    if not 8 <= anchor <= width or keep not in ("first", "none"):
        raise ValueError("anchor must be from 8 to width, keep first or none")
    first = keep == "first"
    bits = bits or max(12, min(max_bits, math.ceil(math.log2(max(2, input_bytes(docs)))) - 2))
    rest = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    texts = lean(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("bytes"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("code"), rest.alias("rest")
    )
    long = texts.where(F.octet_length("bytes") >= width).select("doc", "code", "bytes")
    table = docs.sparkSession.sparkContext.broadcast(sketch(long.select("bytes"), width, anchor, bits).tobytes())
    dealt = long.mapInArrow(lambda it: trimmed(_shipped(it, width, anchor, bits, table, first)), SHIPPED).repartition("h").sortWithinPartitions("h", "kind", "h2", "doc", "code", "start")
    spans = dealt.mapInArrow(lambda it: trimmed(_matched(it, width, first)), "doc long, code long, start int, n int")
    spans = spans.groupBy("doc", "code").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = texts.join(spans, ["doc", "code"], "left").select("doc_id", "bytes", "spans", "rest")
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<first:int,end:int>>, rest {joined.schema['rest'].dataType.simpleString()}"
    return joined.mapInArrow(lambda it: trimmed(_cut(it, width)), schema).drop(*([] if carry else ["rest"]))


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    out = suffix_dedup(table(spark, sf_dir, "documents"), keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
