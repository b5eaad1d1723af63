"""Text columns of Arrow batches as numpy arrays, cut into slices of bounded bytes."""
from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


@contextmanager
def short_batches(spark: SparkSession, rows: int):
    """While this holds, Arrow batches have at most so many rows: Spark's 10,000 whole texts would be some hundred MB in
    every worker and executor.  What is run later doesn't see it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges (i, j) of at most ``limit`` bytes each, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, _STEP)]), dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lower_table() -> np.ndarray:
    """Bytes with A-Z lowered."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: np.ndarray | None = None):
    """(start, end, row, 64-bit hash) of each maximal run of word bytes inside one row.

    ``is_word`` is a 256-entry mask; A-Z count as a-z in the hash.
    """
    lower = lower_table() if lower is None else lower
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1 : len(data)]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1 : len(data)]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, s, "right") - 1
    if not len(s):
        return s, e, row, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    lens = e - s
    heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(len(at)) - np.repeat(heads, lens)
    value = _BYTE[lower][data[at]] * _powers(int(lens.max()))[pos]
    return s, e, row, mix(np.add.reduceat(value, heads) + lens.astype(np.uint64))


def mask(keep) -> np.ndarray:
    """256-entry mask of the bytes for which keep(byte) holds."""
    return np.array([keep(b) for b in range(256)], bool)


#: Words that white space (space, \t to \r) separates; and letters, digits and all beyond ASCII.
NOT_SPACE = mask(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = mask(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def column_as(batch: pa.RecordBatch, name: str, kind: pa.DataType):
    return batch.column(name).cast(kind)
