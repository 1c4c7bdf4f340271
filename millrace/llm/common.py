"""What the operators of this package share: partition counts, checkpoints, array packing, folds."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions; groups and buckets are cut to it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where that is unset, as in tests, one is made here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts for Python are kept to BATCH_ROWS rows, unless the session asks for a number of its own."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def trim() -> None:
    """Gives a Python worker's free memory back, as workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fold(column: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(k)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, as planes of bytes; unsigned 64-bit arrays, if sorted, as their steps."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.array([ord(a.dtype.char), len(a)], np.int64).tobytes())
        if a.dtype == np.uint64 and len(a):
            a = np.append(a[:1], a[1:] - a[:-1])
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(n):
        kind, size = np.frombuffer(raw, np.int64, 2, at)
        at += 16
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, -1)
        at += size * dtype.itemsize
        a = np.ascontiguousarray(planes.T).view(dtype).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if dtype == np.uint64 else a)
    return out


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


B = 0x9E3779B97F4A7C15 | 1
B_INV = pow(B, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of B and of its inverse, modulo 2^64; kept between calls."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((B, B_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


PIECE = 1 << 20


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` in UTF-8 bytes, in order, with A-Z in lower case; where each starts.

    Long input is cut at white space, so that memory is bounded by PIECE bytes and the longest word.
    """
    if len(raw) > 2 * PIECE:
        found, at = [], 0
        while at < len(raw):
            end = at + PIECE
            while end < len(raw) and not SPACE[raw[end]]:
                end += 1
            hashes, starts = words_of(raw[at:end]) if end - at <= 2 * PIECE else _words(raw[at:end])
            found.append((hashes, starts + at))
            at = end
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    return _words(raw)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = LOWER[np.frombuffer(raw, np.uint8)]
    inner = ~SPACE[b]
    edge = np.diff(inner.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * power[: len(b)], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def word_hashes(text: str | None) -> np.ndarray:
    return words_of((text or "").encode("utf-8", "surrogatepass"))[0]
