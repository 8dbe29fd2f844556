"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenised where they are read and dealt to groups by a hash, about ``GROUP`` documents each; groups are packed
independently, so nothing but one group is ever in memory and the result does not depend on how partitions fall. A document
longer than a sequence fills whole ones first. Then first-fit decreasing places the pieces, the emptiest sequences are cut
up to fill what the others have left, and the one sequence that may stay short is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import Splitter
from quire.llm.text import HELD, lean, row_chunks, trimmed, whole_text

LENGTH, GROUP = 4096, 2048
#: Tokens of a group that are packed together at most.
GROUP_TOKENS = 1 << 23
#: Groups of a task, about.
TEAMS = 4
#: Bytes of text tokenised at a time.
PIECE = 1 << 22


class WordTokenizer:
    """A word-level tokenizer file with the outputs of words kept, up to a bound.

    Words are independent of each other in such a vocabulary, so new words of many texts are encoded in one call. Texts
    with special tokens, or with characters on which two libraries could disagree about case, letters or white space, go to
    the tokenizer whole.
    """

    #: The vocabulary's own split, and characters whose lower case and class are beyond doubt.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ‐-‧€]*")

    def __init__(self, path: str, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.last) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = Splitter(self.SPLIT).quick.findall
        self.known = _Known(keep)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.kind)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
        if len(ends) != len(new):
            return [self._whole(word) for word in new]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, two or four bytes each."""
        plain = [self.PLAIN.fullmatch(x) is not None and not any(s in x for s in self.special) for x in texts]
        words = [self.split(x.lower()) if ok else [] for x, ok in zip(texts, plain)]
        found = [list(map(self.known.__getitem__, w)) for w in words]
        if self.known.holes:
            self.known.fill(self._learn(list(self.known.holes)))
        out = [b"".join(f) if ok else self._whole(x) for x, f, ok in zip(texts, found, plain)]
        self.known.turn()
        return out


class _Known(dict):
    """Outputs of words met of late and, up to as many, of earlier ones. A new word gets a hole that is filled later."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.earlier, self.holes = keep, {}, {}

    def __missing__(self, word: str) -> bytes | bytearray:
        out = self.earlier.get(word)
        if out is None:
            out = self.holes[word] = bytearray()
        self[word] = out
        return out

    def fill(self, outputs: list[bytes]) -> None:
        for (word, hole), out in zip(self.holes.items(), outputs):
            hole[:] = out
            self[word] = out
        self.holes = {}

    def turn(self) -> None:
        if len(self) > self.keep:
            self.earlier = dict(self)
            self.clear()


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Tournament:
    """Bins in order of opening; each inner node knows the larger capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts it in the first bin with room, of which there must be one."""
        best, node = self.best, 1
        while node < self.leaves:
            node = 2 * node if best[2 * node] >= size else 2 * node + 1
        found = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return found


Piece = tuple[int, int, int]


def packed(sizes: list[int], length: int = LENGTH) -> list[list[Piece]]:
    """Sequences of pieces (document, start, length) that hold each token of documents of such sizes once."""
    full, pieces = [], []
    for doc, size in enumerate(sizes):
        whole = size - size % length
        full += [[(doc, start, length)] for start in range(0, whole, length)]
        if size > whole:
            pieces.append((doc, whole, size - whole))
    pieces.sort(key=lambda p: -p[2])
    tree, bins = Tournament(max(1, len(pieces)), length), []
    for piece in pieces:
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=fill.__getitem__)
    room = {i: length - fill[i] for i in order if fill[i] < length}
    short = None
    for donor in order:
        room.pop(donor, None)
        if not room:
            short = donor if fill[donor] < length else None
            break
        # the widest gaps first: the fewest cuts
        gaps = sorted(room, key=room.__getitem__)
        while bins[donor] and gaps:
            doc, start, size = bins[donor].pop()
            to = gaps[-1]
            take = min(size, room[to])
            bins[to].append((doc, start, take))
            room[to] -= take
            if take < size:
                bins[donor].append((doc, start + take, size - take))
            if not room[to]:
                del room[to]
                gaps.pop()
        if bins[donor]:
            short = donor
            break
    tail = []
    if short is not None:
        rest, left = bins[short], sum(p[2] for p in bins[short])
        bins[short] = []
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            tail.append([])
            while want:
                doc, start, size = rest.pop()
                take = min(size, want)
                tail[-1].append((doc, start, take))
                want -= take
                if take < size:
                    rest.append((doc, start + take, size - take))
    return full + [b for b in bins if b] + tail


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    HELD["packing"] = _tokenizer.cache_clear
    stop = np.array([end], tokenizer.kind).tobytes()
    # it holds many small objects and no cycles
    gc.disable()
    try:
        for batch in batches:
            for part in row_chunks(batch, "bytes", PIECE):
                ids = tokenizer.encode([x.as_py().decode() for x in part.column("bytes")])
                yield pa.RecordBatch.from_arrays([part.column("team"), part.column("doc_id"), pa.array([x + stop for x in ids], pa.binary())], ["team", "doc_id", "tokens"])
    finally:
        gc.enable()


def _packs(batches: Iterator[pa.RecordBatch], length: int, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Packs one team after another; they come sorted."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    made = 0

    def out(team: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal made
        rows = []
        for sequence in packed([len(h[1]) for h in held], length):
            offset = 0
            for doc, start, size in sequence:
                ids = held[doc][1]
                rows.append((held[doc][0], start, size, ids[start : start + size].astype("<u4").tobytes(), len(ids), team << 32 | made, offset))
                offset += size
            made += 1
        for low in range(0, len(rows), 2000):
            columns = list(zip(*rows[low : low + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names)

    now, held, size = None, [], 0
    for batch in batches:
        for team, doc, raw in zip(batch.column("team").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()):
            if held and (team != now or size >= GROUP_TOKENS):
                yield from out(now, held)
                held, size = [], 0
            if team != now:
                now, made = team, 0
            held.append((doc, np.frombuffer(raw, kind)))
            size += len(held[-1][1])
    if held:
        yield from out(now, held)


def pack(docs: DataFrame, tokenizer_path: str, end: int = 2, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids (32 bits each, little-endian), doc_tokens,
    sequence_id and offset.

    A document (columns used: doc_id, text) is its token ids without special ones, then ``end``; null and empty texts are
    ``end`` alone. Rows with equal or null doc_id are documents of their own. No documents, no rows. Where two pieces of
    a sequence meet is where their documents were cut or end.
    """
    teams = max(1, round(docs.count() / group))
    team = F.pmod(F.xxhash64("doc_id", "text"), F.lit(teams))
    texts = lean(docs).select(team.alias("team"), "doc_id", whole_text().alias("bytes"))
    tokens = texts.mapInArrow(lambda it: trimmed(_tokens(it, tokenizer_path, end), "packing"), "team long, doc_id long, tokens binary")
    kind = _tokenizer(tokenizer_path).kind
    # a few teams to a task, however many there are
    dealt = tokens.repartition(max(1, -(-teams // TEAMS)), "team").sortWithinPartitions("team", "doc_id", "tokens")
    return dealt.mapInArrow(lambda it: trimmed(_packs(it, length, kind), "packing"), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.text import table

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
