"""FLAC for columns of 8-bit samples: encoding, decoding with all checks, and PCM blocks at sample offsets.

Both directions work on SLICE frames at once, of many streams or of one long one: a step of the decoder reads one Rice code
of every frame. That needs to know where frames start, which the streams written here say in a seek table with a point for
each frame. Streams without one are decoded frame after frame by the same code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import binary_view, lean, row_chunks, trimmed, whole_text

BLOCK = 576
RATE = 8000
#: Frames made or read at a time, and bytes of other steps: bound a worker's arrays, however long a stream is.
SLICE, CHUNK = 1024, 1 << 20
#: Coefficients of the linear predictors written, and bits of each.
ORDER, PRECISION = 4, 8
#: Seek points of one metadata block at most.
POINTS = (1 << 24) // 18 - 1
#: Frame header up to the frame number: sync code and fixed block size; 576 samples at 8 kHz; one channel of 8 bits.
HEAD = bytes([0xFF, 0xF8, 0x24, 0x02])
#: Coefficients of the format's fixed predictors, of the latest sample first. Fixed values.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc_table(polynomial: int, width: int) -> np.ndarray:
    """Checksums of single bytes."""
    out = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ polynomial, out << 1) & ((1 << width) - 1)
    return out


@lru_cache(1)
def _crc16_tables() -> tuple[np.ndarray, np.ndarray]:
    one = crc_table(0x8005, 16)
    pair = np.arange(1 << 16)
    half = one[pair >> 8] ^ (pair << 8 & 0xFFFF)
    return one.astype(np.uint16), (one[half >> 8] ^ (half << 8 & 0xFFFF)).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    table = _crc8_table()
    for byte in data:
        crc = table[crc ^ byte]
    return crc


@lru_cache(1)
def _crc8_table() -> list[int]:
    return crc_table(0x07, 8).tolist()


def crc16(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Frame checksums of parts of the buffer, all at once, two bytes a step."""
    one, two = _crc16_tables()
    order = np.argsort(-sizes, kind="stable")
    at, n = starts[order].copy(), sizes[order]
    crc = np.zeros(len(at), np.uint16)
    wide = np.r_[buf, np.zeros(2, np.uint8)].astype(np.uint16)
    pairs = wide[:-1] << np.uint16(8) | wide[1:]
    live = np.searchsorted(-n, -2 * np.arange(1, int(n.max(initial=0)) // 2 + 1), "right")
    for step, k in enumerate(live):
        crc[:k] = two[crc[:k] ^ pairs[at[:k] + 2 * step]]
    odd = np.flatnonzero(n % 2)
    crc[odd] = one[(crc[odd] >> np.uint16(8)) ^ wide[at[odd] + n[odd] - 1]] ^ (crc[odd] << np.uint16(8))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A number of up to 36 bits in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


@lru_cache(1 << 16)
def frame_head(number: int) -> bytes:
    head = HEAD + coded_number(number)
    return head + bytes([crc8(head)])


def linear_predictors(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frame by ORDER), of the latest sample first, and their shifts, by Levinson's recursion."""
    x = samples.astype(np.float32)
    # sums of products of bytes are exact in 32 bits of floating point up to rounding; quantised anyway
    lags = np.stack([np.einsum("ij,ij->i", x[:, lag:], x[:, : x.shape[1] - lag]) for lag in range(ORDER + 1)], axis=1).astype(float)
    error = np.maximum(lags[:, 0], 1e-9) * (1 + 1e-9)
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (lags[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], lags[:, i:0:-1])) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(a).max(axis=1), 2.0**-14)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(largest)), 0, 14).astype(np.int64)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -limit, limit - 1).astype(np.int32), shift


def _rice(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Rice parameter of each row that suits its mean, and the row's size in bits."""
    k = np.clip(np.floor(np.log2(np.maximum(folded.mean(axis=1, dtype=np.float32), 1))), 0, 8).astype(folded.dtype)
    return k, (folded >> k[:, None]).sum(axis=1, dtype=np.int64) + folded.shape[1] * (1 + k.astype(np.int64))


def frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of signed 8-bit samples (frame by BLOCK) of such numbers, end to end, and their sizes in bytes.

    Each takes the shortest of the fixed predictors 0 to 2, a linear predictor of ORDER coefficients and plain samples.
    """
    n = len(samples)
    coefficients, shift = linear_predictors(samples)
    guess = sum(coefficients[:, i, None] * samples[:, ORDER - 1 - i : BLOCK - 1 - i] for i in range(ORDER)) >> shift[:, None].astype(np.int32)
    residual = {0: samples, 1: np.diff(samples, axis=1), 2: np.diff(samples, 2, axis=1), "linear": samples[:, ORDER:] - guess}
    extra = {0: 10, 1: 18, 2: 26, "linear": 10 + 9 + ORDER * (8 + PRECISION)}
    coded = {}
    for kind, r in residual.items():
        folded = (r << 1) ^ (r >> 31)
        coded[kind] = folded, *_rice(folded)
    kinds = list(coded)
    cost = np.stack([coded[kind][2] + extra[kind] for kind in kinds] + [np.full(n, 8 * BLOCK)])
    choice = np.argmin(cost, axis=0)
    heads = [frame_head(int(i)) for i in number]
    head_size = np.array([len(h) for h in heads])
    lengths = head_size + 1 + (cost.min(axis=0) + 7) // 8 + 2
    offset = np.r_[0, np.cumsum(lengths)]
    total = np.zeros(offset[-1])
    for at, kind in enumerate(kinds):
        rows = np.flatnonzero(choice == at)
        if not len(rows):
            continue
        folded, k = coded[kind][0][rows], coded[kind][1][rows]
        order = ORDER if kind == "linear" else kind
        body = offset[rows] + head_size[rows]
        total[body] = (32 + ORDER - 1 if kind == "linear" else 8 | kind) << 1
        for i in range(order):
            total[body + 1 + i] = samples[rows, i] & 0xFF
        bit = 8 * (body + 1 + order)
        fields = []
        if kind == "linear":
            fields = [(PRECISION - 1, 4), (shift[rows], 5)] + [(coefficients[rows, i] & ((1 << PRECISION) - 1), PRECISION) for i in range(ORDER)]
        # residual coding 0 and partition order 0 in six bits, the Rice parameter in four
        for value, size in [*fields, (0, 6), (k, 4)]:
            _put(total, bit, np.broadcast_to(value, len(rows)).astype(np.int64), size)
            bit = bit + size
        k = k.astype(np.int32)[:, None]
        low = folded.astype(np.int32)
        last = np.cumsum((low >> k) + 1 + k, axis=1, dtype=np.int32) + (bit[:, None] - 1).astype(np.int32)
        # a code's closing one and its low bits are at most nine bits: two bytes once shifted into place
        value = ((1 << k) | (low & ((1 << k) - 1))) << (7 - (last & 7))
        byte = (last >> 3).reshape(-1)
        total += np.bincount(byte, (value & 0xFF).reshape(-1), offset[-1])
        total += np.bincount(byte - 1, (value >> 8).reshape(-1), offset[-1])
    buf = total.astype(np.uint8)
    rows = np.flatnonzero(choice == len(kinds))
    if len(rows):
        body = offset[rows] + head_size[rows]
        buf[body] = 1 << 1
        buf[body[:, None] + 1 + np.arange(BLOCK)] = samples[rows] & 0xFF
    for size in np.unique(head_size):
        rows = np.flatnonzero(head_size == size)
        block = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(-1, size)
        for i in range(size):
            buf[offset[rows] + i] = block[:, i]
    crc = crc16(buf, offset[:-1], lengths - 2)
    buf[offset[1:] - 2] = crc >> 8
    buf[offset[1:] - 1] = crc & 0xFF
    return buf, lengths


def _put(total: np.ndarray, bit: np.ndarray, value: np.ndarray, size: int) -> None:
    """Adds fields of up to nine bits at such bits, one for each row, to byte sums."""
    value = value << (16 - size - (bit & 7))
    total[bit >> 3] += value >> 8
    total[(bit >> 3) + 1] += value & 0xFF


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A stream for each payload of unsigned 8-bit samples, whose length is a positive multiple of BLOCK.

    SLICE frames are made at a time, whichever streams they belong to.
    """
    counts = [len(p) // BLOCK for p in payloads]
    pieces: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    for held in _slices(counts):
        samples = np.concatenate([payloads[i][low * BLOCK : high * BLOCK] for i, low, high in held]).reshape(-1, BLOCK).astype(np.int32) - 128
        buf, lengths = frames(samples, np.concatenate([np.arange(low, high) for _, low, high in held]))
        frame = start = 0
        for i, low, high in held:
            own = lengths[frame : frame + high - low]
            pieces[i].append(buf[start : start + own.sum()].tobytes())
            sizes[i].append(own)
            frame, start = frame + high - low, start + int(own.sum())
    return [_stream(p, made, np.concatenate(own)) for p, made, own in zip(payloads, pieces, sizes)]


def _slices(counts: list[int], together: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (stream, first frame, end) of up to SLICE frames together."""
    together = together or SLICE
    held, size = [], 0
    for i, n in enumerate(counts):
        low = 0
        while low < n:
            high = min(n, low + together - size)
            held.append((i, low, high))
            size += high - low
            low = high
            if size == together:
                yield held
                held, size = [], 0
    if held:
        yield held


def _stream(payload: np.ndarray, made: list[bytes], sizes: np.ndarray) -> bytes:
    n, digest = len(sizes), hashlib.md5()
    for low in range(0, len(payload), CHUNK):
        digest.update((payload[low : low + CHUNK] ^ 0x80).tobytes())
    points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
    points["sample"], points["offset"], points["size"] = np.arange(n) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
    # rate 20 bits, channels - 1 in 3, bits - 1 in 5, samples in 36
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest.digest()
    parts = [(0, info)]
    # a metadata block holds 2**24 - 1 bytes
    for low in range(0, n, POINTS):
        parts.append((3, points[low : low + POINTS].tobytes()))
    head = b"".join(bytes([kind | 0x80 * (i == len(parts) - 1)]) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(parts))
    return b"".join([b"fLaC", head, *made])


class Header:
    """STREAMINFO, and where the frames start if the seek tables name all of them. One or two channels of 8 to 24 bits."""

    def __init__(self, stream: np.ndarray):
        word = lambda a, b: int.from_bytes(stream[a:b].tobytes(), "big")
        if len(stream) < 42 or stream[:4].tobytes() != b"fLaC":
            raise Damaged("no FLAC stream")
        at, last, points = 4, False, []
        while not last:
            last, kind, size = stream[at] >> 7, stream[at] & 0x7F, word(at + 1, at + 4)
            if kind == 0:
                self.smallest, self.block, self.longest = word(at + 4, at + 6), word(at + 6, at + 8), word(at + 11, at + 14)
                packed, self.md5 = word(at + 14, at + 22), stream[at + 22 : at + 38].tobytes()
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                if self.channels > 2 or not 8 <= self.bits <= 24:
                    raise Damaged("only one or two channels of 8 to 24 bits are read")
            elif kind == 3:
                found = np.frombuffer(stream[at + 4 : at + 4 + size].tobytes(), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
                points.append(found["offset"][found["sample"] != 0xFFFFFFFFFFFFFFFF].astype(np.int64))
            at += 4 + size
        self.frames = at
        self.points = np.concatenate(points) if points else np.zeros(0, np.int64)
        if self.smallest != self.block or not self.samples or len(self.points) != -(-self.samples // self.block):
            self.points = np.zeros(0, np.int64)

    @property
    def kind(self) -> np.dtype:
        """Of the samples read."""
        return np.dtype(np.int8 if self.bits == 8 else np.int16 if self.bits <= 16 else np.int32)


class Damaged(ValueError):
    """A checksum or a value that the format forbids."""


def frames_at(buf: np.ndarray, starts: np.ndarray, head: Header) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (channel by sample) of each of the frames that start there, and where each ends. Checksums are verified."""
    data = np.r_[buf, np.zeros(8, np.uint8)]
    wide = data.astype(np.uint32)
    words = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    size, mode, body = _frame_heads(data, starts, head)
    out: list = [None] * len(starts)
    ends = np.zeros(len(starts), np.int64)
    for block, m in sorted(set(zip(size.tolist(), mode.tolist()))):
        rows = np.flatnonzero((size == block) & (mode == m))
        bit = 8 * body[rows]
        sides = []
        for channel in range(head.channels):
            # the channel that holds a difference has a bit more
            width = head.bits + ((m == 8 and channel == 1) or (m == 9 and channel == 0) or (m == 10 and channel == 1))
            samples, bit = _subframes(data, words, bit, block, width)
            sides.append(samples)
        if m == 8:
            sides[1] = sides[0] - sides[1]
        elif m == 9:
            sides[0] = sides[0] + sides[1]
        elif m == 10:
            middle = sides[0] * 2 + (sides[1] & 1)
            sides = [(middle + sides[1]) >> 1, (middle - sides[1]) >> 1]
        ends[rows] = (bit + 7) // 8
        both = np.stack(sides).astype(head.kind)
        for i, row in enumerate(rows):
            out[row] = both[:, :, i]
    crc = crc16(data, starts, ends - starts)
    if np.any(crc != data[ends].astype(np.uint16) << 8 | data[ends + 1]):
        raise Damaged("frame checksum")
    return out, ends + 2


def _frame_heads(data: np.ndarray, starts: np.ndarray, head: Header) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block size, channel assignment and first byte behind the header of frames; header checksums are verified."""
    second, third, channels = data[starts + 1], data[starts + 2].astype(np.int64), data[starts + 3] >> 4
    if np.any((data[starts] != 0xFF) | (second & 0xFE != 0xF8) | (data[starts + 3] & 1 != 0)):
        raise Damaged("frame header")
    own = channels.astype(np.int64)
    if np.any((own != head.channels - 1) & ((head.channels != 2) | (own < 8) | (own > 10))):
        raise Damaged("channel assignment")
    widths = np.array([head.bits, 8, 12, -1, 16, 20, 24, -1])
    if np.any(widths[data[starts + 3] >> 1 & 7] != head.bits):
        raise Damaged("sample size")
    first = data[starts + 4]
    at = starts + 5 + np.where(first < 0x80, 0, _leading()[(~first.astype(np.int64) & 0xFF) << 8].astype(np.int64) - 1)
    code, rate = third >> 4, third & 15
    size = np.where(code == 1, 192, np.where(code < 6, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)))
    byte = data[at].astype(np.int64)
    size = np.where(code == 6, byte + 1, np.where(code == 7, (byte << 8) + data[at + 1] + 1, size))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    if np.any((code == 0) | (rate == 15) | (size > 65535)):
        raise Damaged("frame header")
    table = np.array(_crc8_table())
    for length in np.unique(at - starts):
        rows = np.flatnonzero(at - starts == length)
        crc = np.zeros(len(rows), np.int64)
        for i in range(length):
            crc = table[crc ^ data[starts[rows] + i]]
        if np.any(crc != data[at[rows]]):
            raise Damaged("header checksum")
    return size, own, at + 1


@lru_cache(1)
def _leading() -> np.ndarray:
    """Leading zeros of 16-bit numbers; of none but zeros, more than any code read from one word has."""
    out = 16 - np.array([i.bit_length() for i in range(1 << 16)], np.uint32)
    out[0] = 31
    return out


class _Bits:
    """Reads fields of many frames, each at its own bit."""

    def __init__(self, words: np.ndarray, bit: np.ndarray):
        self.words, self.bit = words, bit

    def take(self, rows, size: int) -> np.ndarray:
        got = (self.words[self.bit[rows] >> 3] << (self.bit[rows] & 7).astype(np.uint32)) >> np.uint32(32 - size)
        self.bit[rows] += size
        return got.astype(np.int64)

    def signed(self, rows, size: int) -> np.ndarray:
        got = self.take(rows, size)
        return got - ((got >> (size - 1)) << size)


def _subframes(data: np.ndarray, words: np.ndarray, bit: np.ndarray, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (sample by frame) of one channel of frames of ``block`` samples, and the bit where each ends."""
    n = len(bit)
    bits = _Bits(words, bit.astype(np.int64))
    head = bits.take(np.arange(n), 8)
    if np.any(head & 0x80):
        raise Damaged("subframe header")
    wasted = np.zeros(n, np.int64)
    for i in np.flatnonzero(head & 1):
        wasted[i] = 1
        while not bits.take(np.array([i]), 1)[0]:
            wasted[i] += 1
    kind = head >> 1
    if np.any((kind > 12) & (kind < 32)) or np.any((kind > 1) & (kind < 8)):
        raise Damaged("reserved subframe")
    out = np.zeros((block, n), np.int64)
    for lost in np.unique(wasted):
        own = (wasted == lost) & (kind < 2)
        rows = np.flatnonzero(own & (kind == 0))
        if len(rows):
            out[:, rows] = bits.signed(rows, width - int(lost))
        rows = np.flatnonzero(own & (kind == 1))
        if len(rows):
            size = width - int(lost)
            if size == 8 and not (bits.bit[rows] & 7).any():
                out[:, rows] = data[(bits.bit[rows] >> 3) + np.arange(block)[:, None]].astype(np.int8)
                bits.bit[rows] += 8 * block
            else:
                for i in range(block):
                    out[i, rows] = bits.signed(rows, size)
        rows = np.flatnonzero((wasted == lost) & (kind >= 8))
        if len(rows):
            part = _Bits(words, bits.bit[rows])
            out[:, rows] = _predicted(data, part, kind[rows], block, width - int(lost))
            bits.bit[rows] = part.bit
    return out << wasted if wasted.any() else out, bits.bit


def _predicted(data: np.ndarray, bits: _Bits, kind: np.ndarray, block: int, width: int) -> np.ndarray:
    """Samples (sample by frame) of frames with predictors and Rice-coded residuals."""
    n, lead, words = len(kind), _leading(), bits.words
    order = np.where(kind >= 32, kind - 31, kind - 8).astype(np.int64)
    most, rows = int(order.max()), np.arange(n)
    if most > block:
        raise Damaged("predictor order")
    value = np.zeros((block, n), np.int64)
    for i in range(most):
        live = np.flatnonzero(order > i)
        value[i, live] = bits.signed(live, width)
    weights, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    for o, row in FIXED.items():
        cols = np.flatnonzero((kind < 32) & (order == o))
        if o and len(cols):
            weights[:o, cols] = np.array(row, np.int64)[:, None]
    linear = np.flatnonzero(kind >= 32)
    if len(linear):
        precision = bits.take(linear, 4) + 1
        shift[linear] = bits.signed(linear, 5)
        if np.any(precision == 16) or np.any(shift < 0):
            raise Damaged("linear predictor")
        for i in range(int(order[linear].max())):
            for size in np.unique(precision):
                live = linear[(precision == size) & (order[linear] > i)]
                if len(live):
                    weights[i, live] = bits.signed(live, int(size))
    method = bits.take(rows, 2)
    if np.any(method > 1):
        raise Damaged("residual coding")
    wide = np.where(method == 1, 5, 4)
    span = block >> bits.take(rows, 4)
    k, raw_size = np.zeros(n, np.int64), np.full(n, -1)
    spans = set(np.unique(span).tolist())
    back, bit = weights[::-1].copy(), bits.bit

    def opened(i: int) -> None:
        """Reads the parameters of partitions that start at sample i."""
        fresh = np.flatnonzero((order <= i) & ((i % span == 0) & (i > 0) | (i == order)))
        for size in np.unique(wide[fresh]):
            new = fresh[wide[fresh] == size]
            k[new] = bits.take(new, int(size))
            raw_size[new] = -1
            for j in new[k[new] == (1 << size) - 1]:
                raw_size[j] = bits.take(np.array([j]), 5)[0]

    def codes(rows, narrow: np.ndarray) -> np.ndarray:
        """The next residual of such frames."""
        at, kk = bit[rows], k[rows]
        x = words[at >> 3] << (at & 7).astype(np.uint32)
        q = lead[x >> np.uint32(16)]
        size = q + kk
        size += 1
        u = (x << q << np.uint32(1) >> np.uint32(1) >> narrow).astype(np.int64)
        u |= q << kk
        if slowly or size.max() > 24:
            # what reaches beyond one word
            for j in np.flatnonzero((size > 24) | (raw_size[rows] >= 0)):
                u[j], size[j] = _slow(data, int(at[j]), int(kk[j]), int(raw_size[rows][j]))
        bit[rows] += size
        r = u & 1
        np.negative(r, out=r)
        u >>= 1
        r ^= u
        return r

    for i in range(int(order.min()), most):
        opened(i)
        live = np.flatnonzero(order <= i)
        slowly = True
        r = codes(live, (31 - np.minimum(k[live], 31)).astype(np.uint32))
        guess = sum((weights[lag] * value[i - 1 - lag] for lag in range(i)), np.zeros(n, np.int64)) >> shift
        value[i, live] = r + guess[live]
    slowly, narrow = False, None
    for i in range(most, block):
        if i == most or any(i % s == 0 for s in spans):
            opened(i)
            slowly = bool((raw_size >= 0).any())
            narrow = (31 - np.minimum(k, 31)).astype(np.uint32)
        r = codes(slice(None), narrow)
        if most:
            guess = np.einsum("ij,ij->j", back, value[i - most : i])
            guess >>= shift
            r += guess
        value[i] = r
    return value


def _slow(data: np.ndarray, bit: int, k: int, raw: int) -> tuple[int, int]:
    """One residual, folded, and its size: of a long unary part or of an escaped partition."""
    get = lambda at, n: int.from_bytes(data[at >> 3 : (at + n + 7 >> 3) + 1].tobytes(), "big") >> (8 * ((at + n + 7 >> 3) + 1 - (at >> 3)) - (at & 7) - n) & (1 << n) - 1
    if raw >= 0:
        v = get(bit, raw) if raw else 0
        v -= (v >> (raw - 1) << raw) if raw else 0
        return (v << 1) ^ (v >> 63), raw
    q = 0
    while not data[bit + q >> 3] >> (7 - (bit + q & 7)) & 1:
        q += 1
    return q << k | get(bit + q + 1, k) if k else q, q + 1 + k


def _one_by_one(stream: np.ndarray, head: Header) -> Iterator[tuple[int, np.ndarray]]:
    """(byte offset, samples) of frames whose places are not known beforehand."""
    at, size = head.frames, max(head.longest, 1 << 14) + 8
    while at < len(stream):
        try:
            samples, ends = frames_at(stream[at : at + size], np.array([0]), head)
            if ends[0] > min(size, len(stream) - at):
                raise IndexError
        except IndexError:
            if at + size >= len(stream):
                raise Damaged("end of stream") from None
            size *= 2
            continue
        yield at, samples[0]
        at += int(ends[0])


def read(streams: list[np.ndarray]) -> list[tuple[Header, np.ndarray, np.ndarray]]:
    """Header, samples (sample by channel, signed) and the byte offset of each frame with the samples before it, of each
    stream, verified down to the stream's MD5. Frames named by seek tables are read SLICE at a time, across streams."""
    heads = [Header(s) for s in streams]
    out = [np.empty((h.samples, h.channels), h.kind) if len(h.points) else None for h in heads]
    marks = [np.c_[h.frames + h.points, np.arange(len(h.points)) * h.block] for h in heads]
    alike: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        if len(h.points):
            alike.setdefault((h.block, h.channels, h.bits), []).append(i)
    for (block, _, _), members in alike.items():
        step = max(1, SLICE * BLOCK // block)
        for held in _slices([len(heads[i].points) for i in members], step):
            parts, starts, base = [], [], 0
            for j, low, high in held:
                i = members[j]
                edge = np.r_[heads[i].points, len(streams[i]) - heads[i].frames] + heads[i].frames
                parts.append(streams[i][edge[low] : edge[high]])
                starts.append(edge[low:high] - edge[low] + base)
                base += len(parts[-1])
            samples, _ = frames_at(np.concatenate(parts), np.concatenate(starts), heads[members[0]])
            at = 0
            for j, low, high in held:
                target = out[members[j]]
                for frame in range(low, high):
                    got = samples[at].T
                    if len(got) != min(block, len(target) - frame * block):
                        raise Damaged("block size")
                    target[frame * block : frame * block + len(got)] = got
                    at += 1
    for i, head in enumerate(heads):
        if out[i] is None:
            found = list(_one_by_one(streams[i], head))
            out[i] = np.concatenate([f[1].T for f in found]) if found else np.zeros((0, head.channels), head.kind)
            before = np.cumsum([0] + [f[1].shape[1] for f in found])
            marks[i] = np.c_[[f[0] for f in found], before[:-1]].astype(np.int64).reshape(-1, 2)
            if head.samples and head.samples != len(out[i]):
                raise Damaged("number of samples")
        digest = hashlib.md5()
        for low in range(0, len(out[i]), CHUNK):
            digest.update(pcm(out[i][low : low + CHUNK], head.bits))
        if head.md5 != bytes(16) and digest.digest() != head.md5:
            raise Damaged("stream checksum")
    return list(zip(heads, out, marks))


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Samples (sample by channel) as little-endian bytes, channels in turn."""
    if bits <= 16:
        return samples.astype("i1" if bits == 8 else "<i2").tobytes()
    return np.ascontiguousarray(samples).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The unsigned samples of each stream of one 8-bit channel, verified down to the stream's MD5."""
    return [_unsigned(samples) for _, samples, _ in read([np.frombuffer(s, np.uint8) for s in streams])]


def _unsigned(samples: np.ndarray) -> np.ndarray:
    """In place: an 8-bit channel as unsigned bytes."""
    out = samples.reshape(-1).view(np.uint8)
    out ^= 0x80
    return out


def _bytes_array(parts: list[np.ndarray]) -> pa.Array:
    """A binary column; a single part is not copied."""
    data = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _views(column: pa.Array) -> list[np.ndarray]:
    buf, at = binary_view(column)
    return [buf[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_chunks(batch, "bytes", CHUNK):
            raw = _views(part.column("bytes"))
            payloads = [np.r_[r, np.full(-len(r) % BLOCK or BLOCK * (not len(r)), 255, np.uint8)] for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a FLAC stream of the text's bytes and padding of 255 up to a positive multiple of BLOCK.

    One row per row of ``docs`` (columns used: doc_id, text). Null and empty texts are one block of padding; null and
    repeated doc_ids pass through; no rows, no rows. A long text is written SLICE frames at a time.
    """
    texts = lean(docs).select("doc_id", whole_text().alias("bytes"))
    return texts.mapInArrow(lambda it: trimmed(_stored(it)), "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Energy, zero crossings and peak of signed samples of one channel."""
    energy = crossings = peak = 0
    for low in range(0, len(samples), CHUNK):
        part = samples[max(0, low - 1) : low + CHUNK].astype(np.int64)
        crossings += int(np.count_nonzero((part[1:] < 0) != (part[:-1] < 0)))
        part = part[1 if low else 0 :]
        energy += int((part * part).sum())
        peak = max(peak, int(np.abs(part).max()))
    return f"energy={energy};crossings={crossings};peak={peak}"


def _known(batch: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows with a value in the column, and the others."""
    valid = batch.column(column).is_valid()
    return (batch, batch.slice(0, 0)) if batch.column(column).null_count == 0 else (batch.filter(valid), batch.filter(pc.invert(valid)))


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "media", "payload", "feature"]
    for batch in batches:
        batch, without = _known(batch, "media")
        if without.num_rows:
            yield pa.RecordBatch.from_arrays([*without.columns, pa.nulls(without.num_rows, pa.binary()), pa.nulls(without.num_rows, pa.string())], names)
        for part in row_chunks(batch, "media", CHUNK):
            texts, payloads = [], []
            for head, samples, _ in read(_views(part.column("media"))):
                if (head.channels, head.bits) != (1, 8):
                    raise Damaged("a payload is one channel of 8 bits")
                texts.append(feature(samples.reshape(-1)))
                payloads.append(_unsigned(samples))
            yield pa.RecordBatch.from_arrays([*part.columns, _bytes_array(payloads), pa.array(texts, pa.string())], names)


def load(media: DataFrame) -> DataFrame:
    """Adds payload, the samples read back, and feature to rows of doc_id, n_bytes, media (others are ignored).

    Null media give a null payload and feature. Damaged streams, and those of more than a channel of 8 bits, raise.
    """
    return lean(media).select("doc_id", "n_bytes", "media").mapInArrow(lambda it: trimmed(_loaded(it)), "doc_id long, n_bytes long, media binary, payload binary, feature string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "block", "sample_offset", "byte_offset", "pcm"]
    for batch in batches:
        for part in row_chunks(_known(batch, "media")[0], "media", CHUNK):
            for doc, (head, samples, marks) in zip(part.column("doc_id"), read(_views(part.column("media")))):
                ends = np.r_[marks[1:, 1], len(samples)].astype(np.int64)
                step = max(1, CHUNK // max(1, head.block * head.channels))
                for low in range(0, len(marks), step):
                    own = range(low, min(low + step, len(marks)))
                    cut = [pcm(samples[marks[i, 1] : ends[i]], head.bits) for i in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(cut), pa.int64()), pa.array(own, pa.int64()), pa.array(marks[low : low + step, 1]), pa.array(marks[low : low + step, 0]), pa.array(cut, pa.binary())], names
                    )


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row per frame of rows of doc_id, media: doc_id, block, sample_offset, byte_offset (of the frame in the stream) and
    pcm, its little-endian signed samples. Streams of one or two channels of 8 to 24 bits and any block size are read.

    Null media have no blocks, nor have streams without samples. Damaged streams raise.
    """
    return lean(media).select("doc_id", "media").mapInArrow(lambda it: trimmed(_blocks(it)), "doc_id long, block long, sample_offset long, byte_offset long, pcm binary")


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    back = load(store(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
