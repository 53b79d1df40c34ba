"""Byte-level views of Arrow string columns and vectorised word and window hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; as these are ASCII, cutting the UTF-8 bytes cuts the code points. Null texts read as empty.
Hashes have 64 bits; comparisons that rest on them alone can err with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once in a task; one longer text is a block of its own.
BLOCK_BYTES = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_SYMBOL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Give freed memory back to the system, as a task's worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets with one more entry than rows)."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SEPARATOR[raw]
    full = offsets[1:] > offsets[:-1]
    first, last = np.empty(len(raw), bool), np.empty(len(raw), bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    start, end = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(18, int(n).bit_length()))
    return up[:n], down[:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2^64, from which ranges() hashes any byte range."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SYMBOL[raw] * powers(len(raw))[0], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal for equal bytes, wherever they stand."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on that has n of them."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[k : k + count]) if k % 4 == 3 or k == n - 1 else out * np.uint64(_BASE) + hashes[k : k + count]
    return out


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row as int64."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64) if len(values) else np.zeros(n, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
