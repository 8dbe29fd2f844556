"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding by a UTF-8 state machine.

In a BPE encoding each token is fixed by the one before it: a sequence of tokens is the encoding of its bytes exactly if
each neighbouring pair is the encoding of the pair's own bytes. So the last token of the encoding of a prefix is the one
token that ends there and pairs validly with the last token of what precedes it. A transducer state holds, for every place
where a token that is not yet complete may have begun, its trie node and the token before it; an arc gives the token that
ends at the byte read. Tokens are emitted at the end of a piece, in a long one as soon as all those places agree on them:
no place lies further back than the longest token, so lookahead is bounded. States and arcs are built when first met and
kept up to a bound; past it the machine starts afresh.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import CHUNK, HELD, lean, row_chunks, trimmed, whole_text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The encoding by the merge rule itself: join the pair of lowest rank, leftmost first, while one is under the bound."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


#: Bytes read at most before tokens are emitted.
LOOKAHEAD = 4096


class Transducer:
    """Encodes pieces; ``states`` bounds the arcs and states that are kept, ``memo`` the pieces whose output is kept."""

    def __init__(self, ranks: dict[bytes, int], states: int = 150_000, memo: int = 300_000):
        self.ranks, self.limit = ranks, states
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.open: list[bool] = [True]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.trie.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.trie[node << 8 | byte] = len(self.depth)
                    self.open[node] = True
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.open.append(False)
                node = nxt
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.pair_limit = 4 * states
        self.split: dict[int, tuple[int, int] | None] = {}
        self.kind = np.dtype("<u2" if max(self.bytes_of) < 1 << 16 else "<u4")
        self.memo = _Memo(self, memo)
        self._fresh()

    def _fresh(self) -> None:
        # a state is a tuple of places, each a trie node << 24 | the token before it plus one
        self.numbers: dict[tuple[int, ...], int] = {(0,): 0}
        self.keys: list[tuple[int, ...]] = [(0,)]
        self.arcs: dict[int, int] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging joins last on the way to this one; none for a byte, or if merging never makes it."""
        if token not in self.split:
            own = self.bytes_of[token]
            parts = merged(own, self.ranks, below=token)
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def valid(self, left: int, token: int) -> bool:
        """Whether the two tokens encode their own bytes; with left -1, whether the token does."""
        known = self.pairs.get(left << 24 | token)
        if known is None:
            if len(self.pairs) > self.pair_limit:
                self.pairs.clear()
            alone = len(self.bytes_of[token]) == 1 or self._halves(token) is not None
            known = self.pairs[left << 24 | token] = alone and (left < 0 or self._stays_apart(left, token))
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        """Undoes merges next to the border, the latest first: no merge across it may have come before one undone."""
        before = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < before:
                return False
            one, other = self._halves(a), self._halves(b)
            if one is None and other is None:
                return True
            if other is None or one is not None and a > b:
                a, before = one[1], a
            else:
                # of equal ranks the leftmost goes first, so across the border comes before inside b
                b, before = other[0], b + 1

    def _arc(self, number: int, byte: int) -> int:
        """The next state << 24 | the token that ends the encoding of what has been read with this byte."""
        going, last = [], -1
        for place in self.keys[number]:
            child = self.trie.get(place >> 24 << 8 | byte)
            if child is None:
                continue
            left = place & 0xFFFFFF
            token = self.token_at[child]
            if last < 0 <= token and self.valid(left - 1, token):
                last = token
            if self.open[child]:
                going.append(child << 24 | left)
        if last < 0:
            raise ValueError("the ranks lack a single byte or are no BPE vocabulary")
        going.append(last + 1)
        key = tuple(going)
        target = self.numbers.get(key)
        if target is None:
            target = self.numbers[key] = len(self.keys)
            self.keys.append(key)
        arc = self.arcs[number << 8 | byte] = target << 24 | last
        return arc

    def _chain(self, lasts: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, of which each has its last token in ``lasts``."""
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[lasts[end - 1]])
        return out[::-1]

    def _settled(self, lasts: list[int], state: int) -> list[int]:
        """The tokens on which all places agree where a token that has not ended may have begun; their bytes leave ``lasts``."""
        chains = [self._chain(lasts, len(lasts) - self.depth[place >> 24]) for place in self.keys[state]]
        shared = 0
        while all(len(c) > shared and c[shared] == chains[0][shared] for c in chains):
            shared += 1
        del lasts[: sum(len(self.bytes_of[t]) for t in chains[0][:shared])]
        return chains[0][:shared]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """One piece's ids. A piece that is a token as a whole is that token, as merging may be unable to reach it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.keys) > self.limit:
            self._fresh()
        state, get, lasts, out = 0, self.arcs.get, [], []
        for byte in piece:
            arc = get(state << 8 | byte)
            if arc is None:
                arc = self._arc(state, byte)
            state = arc >> 24
            lasts.append(arc & 0xFFFFFF)
            if len(lasts) == LOOKAHEAD:
                out += self._settled(lasts, state)
        return (*out, *self._chain(lasts, len(lasts)))

    def packed(self, ids: tuple[int, ...]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def encode(self, text: str, pattern: Splitter) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, pattern(text))), self.kind)


class _Memo(dict):
    """Outputs of pieces met before: those of late, up to a bound, and as many of earlier."""

    def __init__(self, machine: Transducer, limit: int):
        super().__init__()
        self.machine, self.limit, self.earlier = machine, limit, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.earlier.get(piece)
        if out is None:
            out = self.machine.packed(self.machine.encode_piece(piece.encode()))
            if len(piece) > 64:
                return out
        if len(self) >= self.limit:
            self.earlier = dict(self)
            self.clear()
        self[piece] = out
        return out


class Utf8Machine:
    """Decodes a stream of byte strings; an incomplete character waits for its rest, a broken one becomes U+FFFD."""

    #: Ranges of the second byte that are narrower than 80..BF. Fixed values of the Unicode standard.
    SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self) -> None:
        self.held = b""
        self.steps: dict[tuple[bytes, bytes], tuple[bytes, str]] = {}

    def _byte(self, held: bytes, byte: int) -> tuple[bytes, str]:
        if held:
            low, high = self.SECOND.get(held[0], (0x80, 0xBF)) if len(held) == 1 else (0x80, 0xBF)
            if low <= byte <= high:
                held += bytes([byte])
                size = 2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4
                return (b"", held.decode()) if len(held) == size else (held, "")
            rest, text = self._byte(b"", byte)
            return rest, "�" + text
        if byte < 0x80:
            return b"", chr(byte)
        if 0xC2 <= byte <= 0xF4:
            return bytes([byte]), ""
        return b"", "�"

    def feed(self, token: bytes) -> str:
        step = self.steps.get((self.held, token))
        if step is None:
            held, out = self.held, []
            for byte in token:
                held, text = self._byte(held, byte)
                out.append(text)
            if len(self.steps) > 200_000:
                self.steps.clear()
            step = self.steps[self.held, token] = (held, "".join(out))
        self.held = step[0]
        return step[1]

    def close(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""

    def decode(self, tokens: Iterable[bytes]) -> str:
        steps, held, out = self.steps, b"", []
        for token in tokens:
            step = steps.get((held, token))
            if step is None:
                self.held = held
                self.feed(token)
                step = self.steps.get((held, token))
            held = step[0]
            out.append(step[1])
        self.held = held
        out.append(self.close())
        return "".join(out)


@lru_cache(2)
def _machine(path: str) -> Transducer:
    return Transducer(load_ranks(path))


class Splitter:
    """All matches of a pattern, by a faster library where the text holds Latin letters and plain signs only."""

    PLAIN = "".join(map(chr, [9, 10, 13, *range(32, 127), *range(161, 384), *range(0x2010, 0x2028), 0x20AC]))

    def __init__(self, source: str):
        # white space as the Unicode property, whatever a library takes \s for
        self.full = regex.compile(source.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.plain = re.compile(f"[{re.escape(self.PLAIN)}]*")
        classes = {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\p{White_Space}"}
        quick = source.replace(r"\S", r"[^\s]")
        for name, meaning in classes.items():
            quick = quick.replace(name, "<" + meaning[3:-1] + ">")
        for name, meaning in classes.items():
            chars = re.escape("".join(c for c in self.PLAIN if regex.match(meaning, c)))
            tag = "<" + meaning[3:-1] + ">"
            # inside a class its characters alone, outside a class of its own
            parts = re.split(r"(\[[^\]]*\])", quick)
            quick = "".join(x.replace(tag, chars) if x.startswith("[") else x.replace(tag, f"[{chars}]") for x in parts)
        self.quick = re.compile(quick)

    def __call__(self, text: str) -> list[str]:
        return self.quick.findall(text) if self.plain.fullmatch(text) else self.full.findall(text)


@lru_cache(2)
def _pattern(source: str) -> Splitter:
    return Splitter(source)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, source: str) -> Iterator[pa.RecordBatch]:
    machine, pattern = _machine(path), _pattern(source)
    HELD["bpe"] = lambda: (_machine.cache_clear(), _decoder.cache_clear())
    # the machine holds many small objects and no cycles: looking for cycles again and again would take half the time
    gc.disable()
    try:
        yield from _encoded_batches(batches, machine, pattern)
    finally:
        gc.enable()


def _encoded_batches(batches: Iterator[pa.RecordBatch], machine: Transducer, pattern: Splitter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_chunks(batch, "bytes", 2 * CHUNK):
            flat, ends = [], [0]
            for raw in part.column("bytes"):
                ids = machine.encode(raw.as_py().decode(), pattern)
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Returns doc_id and ids (array<int>) for each row of ``docs``, each match of the pattern encoded separately.

    Null and empty texts give an empty array; null and repeated doc_ids pass through. Other columns are ignored. The
    vocabulary file must be at ``ranks_path`` on every worker.
    """
    texts = lean(docs).select("doc_id", whole_text().alias("bytes"))
    return texts.mapInArrow(lambda it: trimmed(_encoded(it, ranks_path, pattern), "bpe"), "doc_id long, ids array<int>")


class TokenDecoder:
    """The UTF-8 machine over token ids: a table of its steps. From the start state most tokens lead back to it, and the
    table's row of that state is a list by id; other steps are worked out when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.utf8, self.bytes_of = Utf8Machine(), {rank: token for token, rank in ranks.items()}
        self.start: list[str | None] = [None] * (max(self.bytes_of) + 1)
        for rank, token in self.bytes_of.items():
            held, out = b"", []
            for byte in token:
                held, text = self.utf8._byte(held, byte)
                out.append(text)
            self.start[rank] = "".join(out) if not held else None

    def __call__(self, ids: list[int]) -> str:
        steps = list(map(self.start.__getitem__, ids))
        at = 0
        while True:
            # as far as the next token that leaves the start state
            try:
                at = steps.index(None, at)
            except ValueError:
                return "".join(steps)
            while at < len(ids):
                steps[at] = self.utf8.feed(self.bytes_of[ids[at]])
                at += 1
                if not self.utf8.held:
                    break
            else:
                return "".join(steps) + self.utf8.close()


@lru_cache(2)
def _decoder(path: str) -> TokenDecoder:
    return TokenDecoder(load_ranks(path))


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = _decoder(path)
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            ids = part.column("ids")
            flat, at = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy())]
            texts = [decoder(flat[a:b].tolist()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (string) to rows of doc_id and ids; null ids decode to the empty text."""
    # a worker that has encoded before drops what it held for that
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: trimmed(_decoded(it, ranks_path)), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded, as ``decode(encode(...))``, both in one worker: ids do not travel between two, and a worker
    that has held the transducer never waits beside another that builds it again."""
    texts = lean(docs).select("doc_id", whole_text().alias("bytes"))
    both = lambda it: trimmed(_decoded(_encoded(it, ranks_path, pattern), ranks_path), "bpe")
    return texts.mapInArrow(both, "doc_id long, ids array<int>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.text import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
