"""Vectorised words, word hashes and n-gram hashes over the buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are hashed in runs of about this many bytes, so temporaries stay small and in cache.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1

#: ASCII white space, and A-Z to a-z.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


NOT_SPACE = byte_class(lambda b: b not in WHITE_SPACE)


#: Rows of text that the session sends to Python at once, at most.
BATCH_ROWS = 1000


def batched(df):
    """``df``, with its session told to send rows to Python in batches of at most BATCH_ROWS: texts are wide rows.

    Only lowers ``spark.sql.execution.arrow.maxRecordsPerBatch``; results don't depend on it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the public splitmix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=_U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


@lru_cache(maxsize=8)
def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    if size > 8 * CHUNK_BYTES:  # of a single very long text: not worth keeping
        return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    return _power_tables(base, size)


def sums_of_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range, from prefix sums; equal ranges hash equally."""
    up, down = power_tables(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=total[1:], dtype=_U)
    return (total[ends] - total[starts]) * down[starts]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of a string column.

    A null row has no bytes.  Nothing is copied but the run's offsets.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each text, and each text's first word.

    The last has one entry more than there are texts: words of text i are
    first[i] to first[i + 1].
    """
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    h = sums_of_ranges(data.astype(_U) + _U(1), starts, ends, _BASE)
    return mix(h ^ ((ends - starts).astype(_U) * _U(_STEP)))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for each i for which that is inside the array."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    starts = np.arange(n)
    return mix(sums_of_ranges(words, starts, starts + size, _STEP) + _U(size))
