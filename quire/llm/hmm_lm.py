"""A hidden Markov language model: Baum-Welch across partitions, exact likelihood by the scaled forward recursion.

States emit symbols: each of the ``TOP`` most frequent training words, seen three times or more, is one, every other word falls in one of ``CLASSES``
classes by its last two bytes and emits its class, then itself by its share of the class. So the emission table has a fixed
size, and a word's probability in state s is P(class | s) * (c + 0.5) / (N_class + 0.5 * (V_class + 1)). The counts of
all words stay in a table; only the frequent words, the class totals and the model are sent to executors.

Training starts from words that occur in many documents but seldom in the same ones, and then runs Baum-Welch over all
training tokens, each text whole: each task adds up expected counts of its documents, and the counts are summed shard by
shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import binary_view, fmix, lean, lower_ascii, row_chunks, whole_text, words, written

TOP, CLASSES, STATES, ROUNDS = 49_152, 1_024, 8, 3
#: Words of which it is counted how often two share a document.
SEEDS = 192
END = np.uint64(0x5851F42D4C957F2D)
GATHER = 1 << 20
#: Steps between forward values kept of a long text, and bytes of symbols of long texts that are worked on together.
RUN, POOL = 1024, 1 << 22
SHARD = 1024
#: 64 * log2(3): rarer words are told by their class, whose share also serves for words not seen at all.
STEADY = 101
#: Weight of the corpus's own distribution in a state's emissions, in tokens.
PRIOR = 100.0


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with each text's end token, the class of each, and where each text's tokens start, with the end."""
    buf, at = binary_view(part.column("bytes"))
    hashes, first, ends = words(buf, at, lower=True)
    low = lower_ascii(buf).astype(np.uint64)
    # the byte before a one-byte word's may be white space or another text's last: such words have a class by one byte
    starts = np.zeros(len(ends), bool)
    if len(ends):
        before = np.maximum(ends - 2, 0)
        starts = (ends - 2 >= 0) & ~np.isin(low[before], [9, 10, 11, 12, 13, 32]) & ~np.isin(ends - 1, at)
        code = low[ends - 1] * np.uint64(257) + np.where(starts, low[before], np.uint64(0)) + np.uint64(1)
        kind = (fmix(code) % np.uint64(CLASSES)).astype(np.int32)
    else:
        kind = np.zeros(0, np.int32)
    spots = first[1:]
    return np.insert(hashes, spots, END), np.insert(kind, spots, 0), first + np.arange(len(first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(held: list) -> pa.RecordBatch:
        h, kind = (np.concatenate(x) for x in zip(*held))
        found, at, count = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(kind[at]), pa.array(count)], ["h", "kind", "c"])

    held, size = [], 0
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            h, kind, _ = tokens(part)
            held.append((h, kind))
            size += len(h)
            if size >= GATHER:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


class Lookup:
    """Places of hashes in a list of distinct ones; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        size = 1 << (64 - int(self.bits))
        self.keys, self.place = np.zeros(size + len(keys) + 1, np.uint64), np.full(size + len(keys) + 1, -1, np.int32)
        for i in np.argsort(keys):
            slot = int(keys[i] >> self.bits)
            while self.place[slot] >= 0:
                slot += 1
            self.keys[slot], self.place[slot] = keys[i], i

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.bits).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.place[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        slot = slot[todo]
        while len(todo):
            slot = slot + 1
            hit = self.keys[slot] == hashes[todo]
            out[todo[hit]] = self.place[slot[hit]]
            go = ~hit & (self.place[slot] >= 0)
            todo, slot = todo[go], slot[go]
        return out


def _observed(batches: Iterator[pa.RecordBatch], top) -> Iterator[pa.RecordBatch]:
    """Rows with their tokens as symbols, two bytes each."""
    find = Lookup(top.value)
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            h, kind, first = tokens(part)
            symbol = find(h)
            symbol = np.where(symbol < 0, len(top.value) + kind, symbol).astype("<u2")
            blobs = [symbol[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), part.column("held_out"), pa.array(blobs, pa.binary())], ["doc_id", "text_hash", "held_out", "symbols"])


def _rare(batches: Iterator[pa.RecordBatch], top) -> Iterator[pa.RecordBatch]:
    """Words without a symbol of their own: (h, kind, doc_id, text_hash, n)."""
    find = Lookup(top.value)
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            h, kind, first = tokens(part)
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            take = find(h) < 0
            h, kind, owner = h[take], kind[take], owner[take]
            order = np.lexsort((h, owner))
            h, kind, owner = h[order], kind[order], owner[order]
            head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.r_[head, len(h)]).astype(np.int32)
            ids, codes = part.column("doc_id").take(pa.array(owner[head])), part.column("text_hash").take(pa.array(owner[head]))
            yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(kind[head]), ids, codes, pa.array(n)], ["h", "kind", "doc_id", "text_hash", "n"])


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """In how many documents two of the first ``size`` symbols occur: (i, j, n)."""
    total = np.zeros((size, size))
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            column = batch.column("symbols").slice(low, 2000)
            there = np.zeros((len(column), size), np.float32)
            flat, at = binary_view(column)
            symbol = flat.view("<u2") if flat.flags["ALIGNED"] and len(flat) % 2 == 0 else np.frombuffer(flat.tobytes(), "<u2")
            owner = np.repeat(np.arange(len(column)), np.diff(at) // 2)
            take = symbol < size
            there[owner[take], symbol[take]] = 1
            total += there.T @ there
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "n"])


def started(together: np.ndarray, share: np.ndarray, states: int) -> dict[str, np.ndarray]:
    """A model whose states prefer words that share documents; ``share`` is the corpus's distribution of symbols."""
    count = np.maximum(np.diag(together), 1)
    link = together / np.sqrt(np.outer(count, count))
    picked = [0]
    while len(picked) < min(states, len(count)):
        # far from those picked, and frequent
        worth = (1 - link[:, picked].max(axis=1)) * np.log1p(count)
        worth[picked] = -1
        picked.append(int(worth.argmax()))
    emit = np.tile(share, (states, 1))
    lean = link[:, picked].T ** 2 + 0.02
    lean = np.vstack([lean, np.full((states - len(picked), lean.shape[1]), lean.mean())]) if len(picked) < states else lean
    emit[:, : len(count)] *= lean / lean.mean(axis=0)
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return {"start": np.full(states, 1 / states), "move": move, "emit": emit}


def by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences by falling length, and how many are longer than t for each t."""
    order = np.argsort(-lengths, kind="stable")
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
    return order, alive


def forward(symbols: np.ndarray, first: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence."""
    lengths = np.diff(first)
    order, alive = by_time(lengths)
    begin, emit, move = first[:-1][order], np.ascontiguousarray(model["emit"].T), model["move"]
    out = np.zeros(len(lengths))
    scale = np.ones(len(lengths))
    alpha = np.tile(model["start"], (len(lengths), 1))
    for t, n in enumerate(alive):
        alpha = (alpha[:n] @ move if t else alpha[:n]) * emit[symbols[begin[:n] + t]]
        total = alpha.sum(axis=1)
        alpha /= total[:, None]
        scale[:n] *= total
        if t % 16 == 15:
            out[:n] += np.log10(scale[:n])
            scale[:n] = 1
    out += np.log10(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected(symbols: np.ndarray, first: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (symbol by state) of sequences.

    Of sequences longer than RUN the first pass keeps the forward values every RUN steps; the way back takes a run at a time
    and works them out again, so memory follows the number of sequences, not their length.
    """
    states, size = model["emit"].shape
    order, alive = by_time(np.diff(first))
    begin, move = first[:-1][order], model["move"].astype(np.float32)
    emit = np.ascontiguousarray(model["emit"].T).astype(np.float32)
    start = model["start"].astype(np.float32)

    def ahead_of(low: int, gate: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Where each step's rows lie, symbols, emissions, scaled forward values and scales of the run from ``low``."""
        here = alive[low : low + RUN]
        at = np.r_[0, np.cumsum(here)]
        seen = np.concatenate([symbols[begin[:n] + t] for t, n in enumerate(here, low)])
        likely = emit[seen]
        alpha, total = np.empty((at[-1], states), np.float32), np.empty(at[-1], np.float32)
        for t, n in enumerate(here):
            a = (gate[:n] @ move if gate is not None else np.tile(start, (n, 1))) * likely[at[t] : at[t + 1]]
            s = a.sum(axis=1)
            total[at[t] : at[t + 1]] = s
            gate = np.divide(a, s[:, None], out=alpha[at[t] : at[t + 1]])
        return at, seen, likely, alpha, total

    starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
    lows, gates, run = range(0, len(alive), RUN), [None], None
    for low in lows:
        run = ahead_of(low, gates[-1])
        gates.append(run[3][run[0][-2] :].copy())
    ahead = None
    for k in range(len(lows) - 1, -1, -1):
        at, seen, likely, alpha, total = run if k == len(lows) - 1 else ahead_of(lows[k], gates[k])
        gamma = np.empty_like(alpha)
        for t in range(len(at) - 2, -1, -1):
            rows = slice(at[t], at[t + 1])
            beta = np.ones((at[t + 1] - at[t], states), np.float32)
            if ahead is not None:
                beta[: len(ahead)] = ahead @ move.T
                moves += alpha[rows][: len(ahead)].T.astype(float) @ ahead
            np.multiply(alpha[rows], beta, out=gamma[rows])
            ahead = likely[rows] * beta / total[rows, None]
        emitted += np.stack([np.bincount(seen, gamma[:, s], size) for s in range(states)], axis=1)
        if k == 0:
            starts = gamma[: alive[0]].sum(axis=0, dtype=float)
    return starts, moves * model["move"], emitted


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a column of sequences, and where each starts, with the end."""
    flat, at = binary_view(column)
    return np.frombuffer(flat.tobytes(), "<u2").astype(np.int64), at // 2


def _expected(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    states, size = model["emit"].shape
    sums = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))

    def add(column: pa.Array) -> None:
        for have, more in zip(sums, expected(*sequences(column), model)):
            have += more

    # long texts wait for each other: a step costs the same for one as for many
    held, waiting = [], 0
    for batch in batches:
        for part in row_chunks(batch, "symbols"):
            column = part.column("symbols")
            long = pc.greater(pc.binary_length(column), 2 * RUN)
            if pc.any(long).as_py():
                held.append(column.filter(long))
                waiting += pc.sum(pc.binary_length(held[-1])).as_py()
                column = column.filter(pc.invert(long))
            if len(column):
                add(column)
            if waiting >= POOL:
                add(pa.concat_arrays(held))
                held, waiting = [], 0
    if held:
        add(pa.concat_arrays(held))
    starts, moves, emitted = sums
    blobs = [np.r_[starts, moves.reshape(-1)].tobytes()] + [emitted[i : i + SHARD].astype(np.float32).tobytes() for i in range(0, size, SHARD)]
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blobs) - 1), pa.int32()), pa.array(blobs, pa.binary())], ["shard", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each shard; rows come sorted by shard."""
    now, total = None, np.zeros(0)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["shard", "counts"])
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist()):
            values = np.frombuffer(blob, float if shard < 0 else np.float32).astype(float)
            if shard != now:
                if now is not None:
                    yield row()
                now, total = shard, values
            else:
                total = total + values
    if now is not None:
        yield row()


def improved(observed: DataFrame, model: dict[str, np.ndarray], share: np.ndarray) -> dict[str, np.ndarray]:
    """The model after one round of Baum-Welch over the training rows of ``observed``."""
    states, size = model["emit"].shape
    sent = observed.sparkSession.sparkContext.broadcast(model)
    parts = observed.where("not held_out").select("symbols").mapInArrow(lambda it: _expected(it, sent), "shard int, counts binary")
    rows = parts.repartition(-(-size // SHARD) + 1, "shard").sortWithinPartitions("shard").mapInArrow(_summed, "shard int, counts binary").collect()
    got = {r["shard"]: np.frombuffer(r["counts"]) for r in rows}
    if -1 not in got:
        return model
    starts, moves = got[-1][:states] + 1, got[-1][states:].reshape(states, states) + 1
    emitted = np.concatenate([got[i].reshape(-1, states) for i in sorted(got) if i >= 0]).T + PRIOR * share
    return {"start": starts / starts.sum(), "move": moves / moves.sum(axis=1, keepdims=True), "emit": emitted / emitted.sum(axis=1, keepdims=True)}


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model, base = sent.value
    table = np.r_[base, np.zeros(model["emit"].shape[1] - len(base))]
    names = ["doc_id", "text_hash", "held_out", "n_tokens", "known", "base", "likelihood"]
    for batch in batches:
        for low in range(0, batch.num_rows, 2500):
            part = batch.slice(low, 2500)
            symbols, at = sequences(part.column("symbols"))
            sums = [np.add.reduceat(x, at[:-1]) for x in ((symbols < len(base)).astype(np.int64), table[symbols])]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names[:3]] + [pa.array(np.diff(at)), *map(pa.array, sums), pa.array(forward(symbols, at, model))], names)


def score(docs: DataFrame, top: int = TOP, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (columns used: doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, the log10 probabilities of the text under the add-half unigram model and under the HMM.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out; a null doc_id counts as training. Null and empty texts are
    one end token. Repeated rows count as often as they occur. Without training rows nothing is known.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    texts = lean(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), held.alias("held_out"), whole_text().alias("bytes"))
    counts = texts.where("not held_out").select("bytes").mapInArrow(_counted, "h long, kind int, c long")
    counts = written(counts.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c")))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # sixty-four steps to a doubling of the count: a few thousand rows at most, whatever the corpus
    step = F.floor(F.log2("c") * 64)
    left, least = top, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        left -= r["n"]
        if left < 0 or r["step"] < STEADY:
            break
        least = r["step"]
    often_rows = [] if least is None else counts.where(step >= least).collect()  # at most ``top`` rows
    frequent = sorted(often_rows, key=lambda r: (-r["c"], r["h"]))
    keys = np.array([r["h"] for r in frequent], np.int64).view(np.uint64)
    often = np.array([r["c"] for r in frequent], float)
    rare = counts if least is None else counts.where(step < least)
    classes = rare.groupBy("kind").agg(F.sum("c").alias("class_n"), F.count("*").alias("class_v"))
    in_class = {r["kind"]: r["class_n"] for r in classes.collect()}
    share = np.r_[often, [in_class.get(k, 0) for k in range(CLASSES)]] + 0.5
    share /= share.sum()

    sent = spark.sparkContext.broadcast(keys)
    observed = written(texts.mapInArrow(lambda it: _observed(it, sent), "doc_id long, text_hash long, held_out boolean, symbols binary"))
    size = max(1, min(SEEDS, len(keys)))
    shared = observed.where("not held_out").select("symbols").mapInArrow(lambda it: _together(it, size), "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((size, size))
    for r in shared:
        together[r["i"], r["j"]] = r["n"]
    model = started(together, share, states)
    for _ in range(rounds):
        model = improved(observed, model, share)

    n, v = float(whole["n"]), float(whole["v"])
    unit = n + 0.5 * (v + 1)
    ready = spark.sparkContext.broadcast((model, np.log10((often + 0.5) / unit)))
    scored = observed.mapInArrow(lambda it: _scored(it, ready), "doc_id long, text_hash long, held_out boolean, n_tokens long, known long, base double, likelihood double")

    pairs = texts.select("doc_id", "text_hash", "bytes").mapInArrow(lambda it: _rare(it, sent), "h long, kind int, doc_id long, text_hash long, n int")
    # at most CLASSES rows
    every = spark.range(CLASSES).select(F.col("id").cast("int").alias("kind")).join(F.broadcast(classes), "kind", "left").fillna(0)
    c = F.coalesce(F.col("c"), F.lit(0))
    terms = pairs.join(rare.select("h", "c"), "h", "left").join(F.broadcast(every), "kind")
    sums = terms.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / unit)).alias("rare_base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / (F.col("class_n") + 0.5 * (F.col("class_v") + 1)))).alias("rare_score"),
    )
    # rows alike share one sum, of all of them
    alike = scored.groupBy("doc_id", "text_hash", "held_out", "n_tokens", "known", "base", "likelihood").agg(F.count("*").alias("times"))
    one = alike.join(sums.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "rare_known", "rare_base", "rare_score"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    part = lambda name: F.coalesce(F.col(name) / F.col("times"), F.lit(0.0))
    out = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + part("rare_known")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + part("rare_base")).alias("base_score"), (F.col("likelihood") + part("rare_score")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    return score(table(spark, sf_dir, "documents"))
