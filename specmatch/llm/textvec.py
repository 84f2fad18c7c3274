"""Vectorised text primitives over Arrow batches: tokens and hashes without a Python loop over characters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, _BASE_INV)]
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (n + 1 offsets). Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return what a finished task held to the system: the worker lives on beside others."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call
        return


def small_batches(spark: SparkSession) -> None:
    """Arrow batches to Python of at most 1,000 rows and 4 MB, unless the session sets its own: a batch of 10,000 whole texts is held in the JVM and in the worker."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
    give_back()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0], left[1:] = True, space[:-1]
    right[-1], right[:-1] = True, space[1:]
    full = at[1:] > at[:-1]
    left[at[:-1][full]] = True
    right[at[1:][full] - 1] = True
    start = np.flatnonzero(~space & left)
    return start, np.flatnonzero(~space & right) + 1, np.searchsorted(start, at)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gives any substring's hash."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
