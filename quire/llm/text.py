"""Vectorised word hashing over Arrow buffers, shared by the operators on word windows and shingles.

Words are maximal runs of bytes other than the six ASCII white-space bytes of ``bytes.split()``. A word's hash is a pair of
polynomials over its bytes modulo two primes, followed by a 64-bit finaliser: modulo a power of two, words of a certain
regular form would share a hash whatever the base. Window hashes are polynomials over word hashes with two different
multipliers, so two windows of the same words but for one are taken for equal only if those two words share a hash.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time: bounds a worker's arrays at about a dozen times this.
CHUNK = 1 << 20
#: Two primes below 2**31, each with the base of its polynomials.
MODULI = ((2147483647, 1288490189), (2147483629, 1073807359))
WINDOW_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder that the session names."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, a local session (one machine) takes a folder of its own; others raise."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder


def dropped(*frames: DataFrame) -> None:
    """Removes what ``written`` wrote for these frames; they can't be read any more."""
    for df in frames:
        path = WRITTEN.pop(id(df), (None, None))[1]
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Frames of ``written`` and their folders, by id.
WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def lean(df: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """The same rows, which reach Python workers in batches of a few MB, however long the texts: unless the session asks
    for still smaller ones, this sets its limit of bytes to a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name).rstrip("b")) > limit:
        df.sparkSession.conf.set(name, limit)
    return df


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers wait for the next stage beside its own."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: What operators keep in a Python worker from task to task, by operator, as functions that drop it.
HELD: dict[str, Callable[[], None]] = {}


def trimmed(rows: Iterator, owner: str = "") -> Iterator:
    """The rows; first what other operators left in this worker is dropped, and at the end freed memory given back."""
    others = [name for name in HELD if name != owner]
    for name in others:
        HELD.pop(name)()
    if others:
        trim()
    try:
        yield from rows
    finally:
        trim()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the checkpoint folder: as ``checkpointed``, but compressed and by columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[id(out)] = out, path
    return out


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size, as whole files: no job is run for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each modulus, powers of its base below CHUNK and those of the base's inverse."""
    out = []
    for p, base in MODULI:
        both = []
        for b in (base, pow(base, -1, p)):
            row = np.ones(1, np.uint64)
            while len(row) < CHUNK:
                row = np.r_[row, row * np.uint64(pow(b, len(row), p)) % np.uint64(p)]
            both.append(row[:CHUNK].astype(np.uint32))
        out.append((both[0], both[1]))
    return out


def _polynomials(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 62-bit number for each part of the buffer: the polynomials of its bytes modulo two primes."""
    n, out = len(buf), np.zeros(len(starts), np.uint64)
    for (p, base), (up, down) in zip(MODULI, _powers()):
        prime, sums, carry = np.uint64(p), np.empty(n + 1, np.uint64), np.uint64(0)
        sums[0] = 0
        for low in range(0, n, CHUNK):
            # bytes count from 1 and powers have 31 bits: a sum over CHUNK of them has 60
            part = np.cumsum((buf[low : low + CHUNK].astype(np.uint64) + np.uint64(1)) * up[: min(CHUNK, n - low)], dtype=np.uint64)
            if low:
                part = part % prime * np.uint64(pow(base, low, p)) % prime
            sums[low + 1 : low + 1 + len(part)] = part + carry
            carry = sums[low + len(part)] % prime
        value = (sums[ends] % prime + prime - sums[starts] % prime) % prime * down[starts % CHUNK] % prime
        if n > CHUNK:
            back = pow(pow(base, CHUNK, p), -1, p)
            scale = np.array([pow(back, k, p) for k in range(n // CHUNK + 1)], np.uint64)
            value = value * scale[starts // CHUNK] % prime
        out = out << np.uint64(31) | value
    return out


def binary_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each value starts, with the end."""
    if column.type not in (pa.binary(), pa.large_binary()):
        column = column.cast(pa.binary())
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    return (np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)), at - at[0]


def row_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes in the column, one row at least."""
    _, at = binary_view(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def word_hashes(buf: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word, with the end."""
    hashes, first, _ = words(buf, at, lower)
    return hashes, first


def words(buf: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and where each word ends."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    if lower:
        buf = lower_ascii(buf)
    ink = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.r_[False, ink[:-1]]
    after = np.r_[ink[1:], False]
    starts = np.flatnonzero(ink & (edge[:-1] | ~before))
    ends = np.flatnonzero(ink & (edge[1:] | ~after)) + 1
    hashes = fmix(_polynomials(buf, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return hashes, np.searchsorted(starts, at).astype(np.int64), ends


def rolled(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash for each run of ``width`` word hashes, whatever texts they belong to."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= base
        out += hashes[i : n + i]
    return fmix(out)


def inside(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``width`` words lie in one text, and the text of each of those."""
    total = int(first[-1])
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    where = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return where, owner[where]
