"""Near duplicates by BagMinHash: weighted Jaccard similarity of the multisets of word shingles.

Signature. The weight axis is cut into the dyadic intervals (0,1], (1,2], (2,4], (4,8] ...; for every shingle and interval
there is a Poisson process of points (time, component, position) that depends on nothing but the shingle. A document with
weight w sees all points of the intervals up to w, and of the interval that holds w those whose position, halved down the
hierarchy, is not above it. A component's signature is the first point it sees, so two documents agree on it with
probability equal to their weighted Jaccard similarity. Points are drawn in order of time until the time exceeds the
largest first point of any component: about one and a half per shingle of a usual text.

Join. Signatures are banded. Documents with equal multisets are one node from the start. Of the smallest nodes of its
buckets, each node is compared with the one most alike; verified links give components. Then, in buckets that hold several
components, nodes of different ones are compared in blocks, by signature and if close enough by their shingles, and as many
links are written as join them, to be verified by the texts. So each pair of nodes that share a bucket
is in one component or has been compared, without writing the pairs within a group of copies.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import WINDOW_BASES, binary_view, dropped, fmix, inside, lean, rolled, row_chunks, trimmed, whole_text, word_hashes, written

BANDS, ROWS = 30, 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Shingles signed at a time.
GROUP = 1 << 18
#: Share of agreeing components under which a pair is not verified: over four deviations below 0.8.
LOOSE = 0.65
BLOCK = 512
#: Ids up to which a set of ids is broadcast (8 MB); larger sets are joined by an exchange.
SEND = 1_000_000
#: Links that a task of the component search handles at least.
A_TASK = 20_000


def step(k: int) -> np.uint64:
    return np.uint64(k * int(GOLDEN) % 2**64)


def shingles(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and weight of the distinct shingles of each text, sorted by owner. Texts of fewer words have one of all."""
    hashes, first = word_hashes(buf, at, lower=True)
    where, owner = inside(first, width)
    values = rolled(hashes, width, WINDOW_BASES[0])[where]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = np.array([rolled(hashes[first[i] : first[i + 1]], int(n[i]), WINDOW_BASES[1])[0] for i in short], np.uint64)
        owner, values = np.r_[owner, short], np.r_[values, own]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])]) if len(values) else np.zeros(0, np.int64)
    return owner[head], values[head], np.diff(np.r_[head, len(values)])


def signatures(owner: np.ndarray, values: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """A row of ``m`` 32-bit hashes for each text; a text without shingles has zeros."""
    level = np.floor(np.log2(weight)).astype(np.int64)
    parts = []
    for i in range(int(level.max(initial=-1)) + 2):
        # interval i ends at 2**i; it counts as a whole from weight 2**i on, in part from above its lower end
        low, high = (0, 1) if i == 0 else (1 << (i - 1), 1 << i)
        take = np.flatnonzero(weight > low)
        if len(take):
            parts.append((owner[take], fmix(values[take] + step(i + 1)), np.full(len(take), high - low, float), np.minimum(weight[take], high) - low))
    first = np.full(texts * m, np.inf)
    out = np.zeros(texts * m, np.uint32)
    if not parts:
        return out.reshape(texts, m)
    doc, node, rate, limit = (np.concatenate(x) for x in zip(*parts))
    time, last, k = np.zeros(len(doc)), np.full(texts, np.inf), 0
    while len(doc):
        k += 1
        r = fmix(node + step(k))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (m * rate)
        go = np.flatnonzero(time < last[doc])
        doc, node, rate, limit, time, r = (x[go] for x in (doc, node, rate, limit, time, r))
        r = fmix(r ^ WINDOW_BASES[1])
        cell = doc * m + (((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        position = ((r & np.uint64(0xFFFFF)).astype(float) * rate / 2**20).astype(np.int64)
        seen = position < limit
        spot, when = cell[seen], time[seen]
        np.minimum.at(first, spot, when)
        best = first[spot] == when
        out[spot[best]] = fmix(r[seen][best] + GOLDEN).astype(np.uint32)
        last = first.reshape(texts, m).max(axis=1)
    return out.reshape(texts, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        part = sig[:, b * rows : (b + 1) * rows].astype(np.uint64)
        key = np.full(len(sig), b + 1, np.uint64)
        for i in range(rows):
            key = fmix(key * GOLDEN + part[:, i])
        keys[:, b] = key
    return keys


def fingerprints(owner: np.ndarray, values: np.ndarray, weight: np.ndarray, texts: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's multiset."""
    ends, out = np.searchsorted(owner, np.arange(texts + 1)), []
    for salt in WINDOW_BASES:
        total = np.r_[np.uint64(0), np.cumsum(fmix(values * salt + weight.astype(np.uint64)), dtype=np.uint64)]
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out


def _printed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, bytes) with the text's first fingerprint as node."""
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            print_, _ = fingerprints(*shingles(*binary_view(part.column("bytes")), width), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(print_), part.column("bytes")], ["doc_id", "node", "bytes"])


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "f1", "f2", "bands", "sig"]

    def signed(held: list) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.concatenate([h[0] for h in held]), [len(h[0]) for h in held]
        owner = np.concatenate([h[1] + s for h, s in zip(held, np.r_[0, np.cumsum(sizes[:-1])].astype(np.int64))])
        values, weight = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        sig = signatures(owner, values, weight, len(ids), bands * rows)
        prints = fingerprints(owner, values, weight, len(ids))
        keys = band_keys(sig, bands, rows).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
        small = (sig & 0xFF).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, prints), lists, pa.array([x.tobytes() for x in small], pa.binary())], names)

    held, size = [], 0
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            owner, values, weight = shingles(*binary_view(part.column("bytes")), width)
            held.append((part.column("doc_id").to_numpy(zero_copy_only=False), owner, values, weight))
            size += len(values) + part.num_rows
            if size >= GROUP:
                yield from signed(held)
                held, size = [], 0
    if held:
        yield from signed(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows (key, node, to): within a batch only the smallest node of a bucket goes on, the others point to it."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        lists = batch.column("bands")
        keys = lists.flatten().to_numpy()
        owner = np.repeat(nodes, lists.value_lengths().to_numpy())
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        rest = np.ones(len(keys), bool)
        rest[head] = False
        low = np.repeat(owner[head], np.diff(np.r_[head, len(keys)]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[head]), pa.array(owner[head]), pa.nulls(len(head), pa.int64())], ["key", "node", "to"])
        pairs = np.unique(np.c_[owner[rest], low[rest]], axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        # a settled pair needs no bucket: it travels under a key of its own
        own = fmix(pairs[:, 0].astype(np.uint64) * GOLDEN + pairs[:, 1].astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "node", "to"])


def _agreement(batches: Iterator[pa.RecordBatch], loose: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        share = (a == b).mean(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"]).filter(pa.array(share >= loose))


def _grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The multiset of each text's shingles as sorted 32-bit hashes, one for each occurrence."""
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            owner, values, weight = shingles(*binary_view(part.column("bytes")), width)
            nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            codes = (fmix(np.repeat(values, weight) + nth.astype(np.uint64) * GOLDEN) >> np.uint64(32)).astype("<u4")
            ends = np.searchsorted(np.repeat(owner, weight), np.arange(part.num_rows + 1))
            grams = [np.sort(codes[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(grams, pa.binary())], ["node", "grams"])


def _across(batches: Iterator[pa.RecordBatch], loose: float, least: float) -> Iterator[pa.RecordBatch]:
    """Links between components within each (key, i, j), as few as join what can be joined there.

    Rows come sorted by (key, i, j), each of which holds two blocks of nodes at most. A pair that shares several buckets is
    compared in that of the first band in which it agrees. A link comes with the components of its ends before.
    """
    held: list[tuple] = []

    def links() -> pa.RecordBatch:
        _, i, j = held[0][0]
        sig = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
        marks = np.array([r[7] for r in held])
        begun = np.array([r[2] for r in held])
        node, part, block = (np.array([r[k] for r in held]) for k in (1, 2, 4))
        grams = [np.frombuffer(r[5], "<u4") for r in held]
        size = np.array([len(g) for g in grams])
        band = held[0][6]
        out: list[tuple[int, int, int, int]] = []
        for x in range(len(held) - 1):
            # what is linked here becomes one component here
            other = x + 1 + np.flatnonzero((part[x + 1 :] != part[x]) & ((block[x + 1 :] != block[x]) | (i == j)))
            other = other[np.minimum(size[other], size[x]) >= least * np.maximum(size[other], size[x])]
            if not len(other):
                continue
            share = (sig[other] == sig[x]).mean(axis=1)
            good = np.flatnonzero(share >= loose)
            # a band's key, cut to 32 bits: the first that both share is that of the bucket where they are compared
            good = good[(marks[other[good]] == marks[x]).argmax(axis=1) == band]
            for y in other[good[np.argsort(-share[good], kind="stable")]]:
                if part[y] != part[x]:
                    shared = len(np.intersect1d(grams[x], grams[y], True))
                    if shared >= least * (size[x] + size[y] - shared):
                        high, low = (x, y) if node[x] > node[y] else (y, x)
                        out.append((node[high], node[low], begun[high], begun[low]))
                        part[part == part[y]] = part[x]
        return pa.RecordBatch.from_arrays([pa.array([int(p[i]) for p in out], pa.int64()) for i in range(4)], ["a", "b", "part_a", "part_b"])

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "part", "sig", "block", "grams", "band", "marks"))):
            if held and held[0][0] != r[:3]:
                yield links()
                held = []
            held.append((r[:3], *r[3:]))
    if held:
        yield links()


def _overlap(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose multisets of shingles overlap enough."""
    for batch in batches:
        for part in row_chunks(batch, "text_a"):
            sides = [shingles(*binary_view(part.column(c)), width) for c in ("text_a", "text_b")]
            owner, values = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
            weight = np.concatenate([s[2] for s in sides])
            order = np.lexsort((values, owner))
            owner, values, weight = owner[order], values[order], weight[order]
            same = np.flatnonzero((owner[1:] == owner[:-1]) & (values[1:] == values[:-1]))
            shared = np.bincount(owner[same], np.minimum(weight[same], weight[same + 1]), part.num_rows)
            total = np.bincount(owner, weight, part.num_rows)
            similar = shared / np.maximum(total - shared, 1)
            keep = pa.array(similar >= least)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similar)], ["a", "b", "similarity"]).filter(keep)


def few(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` with such doc_ids, of which there are ``n`` at most: they are broadcast if that is few enough."""
    return docs.join(F.broadcast(ids) if n <= SEND else ids.distinct(), "doc_id", "left_semi")


def narrow(df: DataFrame, n: int) -> DataFrame:
    """No more partitions than ``n`` rows are worth: each costs every later exchange a file."""
    return df.coalesce(max(1, -(-n // A_TASK)))


def verified(texts, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """Of distinct, written pairs (a, b) those at least so similar, with similarity. ``texts`` gives rows (node, bytes), one
    per node, for a frame of nodes and a bound of their number."""
    n = pairs.count()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a", "b"), F.struct(F.col("b").alias("node"), "a", "b"))).alias("e")).select("e.*")
    held = ends.join(texts(ends.select("node"), 2 * n), "node").select("a", "b", "node", "bytes")
    sides = held.groupBy("a", "b").agg(F.max(F.when(F.col("node") == F.col("a"), F.col("bytes"))).alias("text_a"), F.max(F.when(F.col("node") == F.col("b"), F.col("bytes"))).alias("text_b"))
    return sides.mapInArrow(lambda it: trimmed(_overlap(it, width, least)), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, part) for every node of the links (a, b): part is the smallest node of its component.

    Large-star and small-star steps by turns, each written, until the links no longer change. No links, no rows.
    """

    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, "u")

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(links)
    while before[0]:
        n = before[0]
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = narrow(narrow(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), n).distinct(), n)
        small = narrow(star(large), n)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(narrow(narrow(small, n).distinct(), n))
        after = state(now)
        dropped(links)
        links = now
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("part"))).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, loose: float = LOOSE) -> DataFrame:
    """One row per row of ``docs`` (columns used: doc_id, text): doc_id, class_id (the smallest doc_id of its class) and
    kept, whether the row stands for its class.

    Two documents are linked if the weighted Jaccard similarity of their multisets of word 5-grams, A-Z lower-cased, is
    0.8 or more; classes are the components of those links. Texts of fewer words are one shingle. Texts without words
    (null, empty) have equal, empty multisets and so one class. Rows with a null doc_id are dropped from comparison and
    come back with a null class, kept. Rows with equal doc_id are compared each with its own text; the id belongs to the
    smallest of their classes, and is kept if it stands for that.
    """
    texts = lean(docs).select("doc_id", whole_text().alias("bytes"))
    known = texts.where(F.col("doc_id").isNotNull())
    signed = written(known.mapInArrow(lambda it: trimmed(_signed(it, width, bands, rows)), "doc_id long, f1 long, f2 long, bands array<long>, sig binary"))
    total = signed.count()
    # a node is a multiset, named by its smallest doc_id, or by its fingerprint where ids are not texts' names
    named = signed.select("doc_id").distinct().count() == total
    first = signed.groupBy("f1", "f2").agg(F.min_by(F.struct("doc_id", "bands", "sig"), "doc_id").alias("n"))
    nodes = written(first.select("f1", "f2", F.col("n.doc_id").alias("doc_id"), (F.col("n.doc_id") if named else F.col("f1")).alias("node"), "n.bands", "n.sig"))
    prints = written(signed.select("doc_id", "f1", "f2"))
    dropped(signed)

    def bytes_of(wanted: DataFrame, n: int) -> DataFrame:
        if named:
            return few(known, wanted.withColumnRenamed("node", "doc_id"), n).withColumnRenamed("doc_id", "node")
        theirs = nodes.join(wanted.distinct(), "node", "left_semi")
        rows_of = few(known, theirs.select("doc_id"), n).dropDuplicates(["doc_id", "bytes"])
        own = rows_of.mapInArrow(lambda it: trimmed(_printed(it, width)), "doc_id long, node long, bytes binary")
        return own.join(theirs.select("doc_id", "node"), ["doc_id", "node"]).groupBy("node").agg(F.min("bytes").alias("bytes"))

    stars = nodes.select("node", "bands").mapInArrow(_stars, "key long, node long, to long")
    low = F.min("node").over(Window.partitionBy("key"))
    pairs = stars.withColumn("low", low).select(F.col("node").alias("a"), F.coalesce("to", "low").alias("b")).where("a <> b").distinct()
    sigs = nodes.select("node", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        two = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        return two.select("a", "b", "sig_a", "sig_b").mapInArrow(lambda it: _agreement(it, loose), "a long, b long, share double")

    # the likeliest of a node's pairs first: most others are then within a component
    tried = written(likely(pairs).groupBy("a").agg(F.max_by("b", F.struct("share", -F.col("b"))).alias("b")))
    links = written(verified(bytes_of, tried, width, least).select("a", "b"))
    parts = written(narrow(components(links), 2 * links.count()))
    dropped(tried)

    member = nodes.select("node", "bands").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).select("node", "part", F.posexplode("bands").alias("band", "key"))
    mixed = member.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).where("x < y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mixed = written(mixed)
    n_mixed = mixed.count()
    placed = written(member.join(F.broadcast(mixed) if n_mixed <= SEND else mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    within = written(placed.select("node").distinct())
    grams = bytes_of(within, within.count()).mapInArrow(lambda it: trimmed(_grams(it, width)), "node long, grams binary")
    marks = F.transform("bands", lambda key: F.shiftright(key, 32).cast("int")).alias("marks")
    detail = nodes.select("node", "sig", marks).join(grams, "node")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "part", "block", "band")
    spread = spread.join(detail, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    late = spread.select("key", "i", "j", "node", "part", "sig", "block", "grams", "band", "marks").mapInArrow(lambda it: trimmed(_across(it, loose, least)), "a long, b long, part_a long, part_b long")
    late = written(late.distinct())
    if late.count():
        # one link for each two components: if the texts bear it out, the others say nothing new
        ends = [F.least("part_a", "part_b").alias("x"), F.greatest("part_a", "part_b").alias("y")]
        one = written(late.groupBy(*ends).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "x", "y"))
        good = written(verified(bytes_of, one.select("a", "b"), width, least).select("a", "b"))
        failed = one.join(good, ["a", "b"], "left_anti").select("x", "y")
        rest = written(late.select("a", "b", *ends).join(failed, ["x", "y"], "left_semi").join(one, ["a", "b"], "left_anti").select("a", "b").distinct())
        more = [good, written(verified(bytes_of, rest, width, least).select("a", "b"))] if rest.count() else [good]
        found = functools.reduce(DataFrame.unionByName, more)
        joined = written(narrow(components(links.unionByName(found)), 2 * (links.count() + found.count())))
        dropped(parts, one, rest, *more)
        parts = joined
    dropped(links, mixed, placed, within, late)

    whole = nodes.select("f1", "f2", "node", "doc_id").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    if named:
        classes = whole.select("f1", "f2", F.col("part").alias("class_id"))
    else:
        classes = whole.join(whole.groupBy("part").agg(F.min("doc_id").alias("class_id")), "part").select("f1", "f2", "class_id")
    classes = written(classes)
    dropped(nodes, parts)
    out = prints.join(classes, ["f1", "f2"])
    if not named:
        # an id belongs to the smallest of its texts' classes
        least_class = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
        out = out.select("doc_id").join(least_class, "doc_id")
    out = out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    loose_rows = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(loose_rows)


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    return near_duplicates(table(spark, sf_dir, "documents"))
