"""Kernels and helpers that the corpus operators share.

Texts are handled as UTF-8 bytes: a word is a run of bytes outside
``0x20, 0x09-0x0D``, which on valid UTF-8 is the same as a run of code points
outside those six characters.
"""

from __future__ import annotations

import ctypes
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id, so that such rows sort last.
NULL_ID = 2**63 - 1
#: Bytes of text that a map task works on at a time.
CHUNK_BYTES = 6 << 20
#: Bytes in a batch of the exchange with Python, the last row's apart.
BATCH_BYTES = 2 << 20

U = np.uint64


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one is taken where none is set and all runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="echoplane-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python in batches of about BATCH_BYTES at most from now on: plans are
    made when they run, so the setting has to outlast this call. A number that the user has set
    is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == f"{64 << 20}b":  # the default
        conf.set(key, str(BATCH_BYTES))
    return df


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (_id, _th, text): the id with nulls last and the text's hash, which
    together name a row; rows that repeat both are the same document."""
    text = F.col("text").cast("string")
    return bounded_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"),
        text.alias("text"),
    )


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except OSError:  # another C library: it keeps freed memory as it likes
    _trim = None


def release() -> None:
    """Gives memory that arrays have left behind back to the system: workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.Table]:
    """The batches gathered into tables of about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # A batch holds many rows: slice it where its texts pass the limit.
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)[at:]
            upto = at + int(np.searchsorted(np.cumsum(lengths), limit - size)) + 1
            part = batch.slice(at, min(upto, batch.num_rows) - at)
            held.append(part)
            size += int(lengths[: part.num_rows].sum())
            at += part.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                release()
    if held:
        yield pa.Table.from_batches(held)
        release()


# ---------------------------------------------------------------- words


def words_joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Each text's words followed by one space each, all concatenated; words per text."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            counts[i] = len(w)
            parts.append(b" ".join(w))
    return (b" ".join(parts) + b" " if parts else b""), counts


def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of joined start and end."""
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def slice_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice data[start:end], eight bytes at a step."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ (loads[starts] & _KEEP[np.minimum(left, 8)]))
    live, at = np.flatnonzero(left > 8), 8
    while len(live):
        rest = left[live] - at
        h[live] = mix((h[live] * U(0x9E3779B97F4A7C15)) ^ (loads[starts[live] + at] & _KEEP[np.minimum(rest, 8)]))
        at += 8
        live = live[rest > 8]
    return h


_Q = U(0x2545F4914F6CDD1D)
_QI = U(pow(0x2545F4914F6CDD1D, -1, 2**64))


class Rolling:
    """Hashes of runs of words in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, h: np.ndarray):
        n = len(h) + 1
        powers = np.cumprod(np.full(n, _Q, np.uint64))
        self.inverse = np.cumprod(np.full(n, _QI, np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * powers[: len(h)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of words first..last-1."""
        return mix((self.sums[last] - self.sums[first]) * self.inverse[first])


def slices_equal(data: bytes, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Whether data[s1:e1] == data[s2:e2], for arrays of slices."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    same = (e1 - s1) == (e2 - s2)
    live, at = np.flatnonzero(same), 0
    while len(live):
        rest = (e1 - s1)[live] - at
        keep = _KEEP[np.clip(rest, 0, 8)]
        ok = ((loads[s1[live] + at] ^ loads[s2[live] + at]) & keep) == 0
        same[live[~ok]] = False
        live = live[ok & (rest > 8)]
        at += 8
    return same


def runs(flags: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of True; breaks marks places where a run must start anew."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], flags[:-1]])
    after = np.concatenate([flags[1:], [False]])
    first, last = flags & ~before, flags & ~after
    if breaks is not None:
        first |= flags & breaks
        last |= flags & np.concatenate([breaks[1:], [True]])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def merge_intervals(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open intervals, as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(start, kind="stable"):
        s, e = int(start[i]), int(end[i])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def pack(*parts, level: int = 1) -> bytes:
    """Arrays and bytes as one compressed value."""
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(parts, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))
