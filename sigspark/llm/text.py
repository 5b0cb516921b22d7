"""Byte-level views of Arrow text columns, shared by the operators.

All helpers work on one Arrow batch: the texts of the batch lie in one uint8
array with row offsets, so word and line scans are a few numpy passes instead
of per-row Python.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once inside a task.
SLICE_BYTES = 8 << 20


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text stays below ``limit`` bytes (one row at least)."""
    _, off = column_buffer(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, everything beyond ASCII
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True

# word bytes of [^\x20\x09-\x0D]
_NONSPACE = np.ones(256, bool)
_NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, off: np.ndarray, kind: str = "alnum") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never crosses a row.

    ``kind``: "alnum" for lower-cased ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, "space" for
    ``[^\\x20\\x09-\\x0D]+``.
    """
    mask = (_ALNUM if kind == "alnum" else _NONSPACE)[buf]
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = mask[:-1]
    first = off[:-1][off[:-1] < n]
    prev[first] = False                       # a row's first byte opens a word
    starts = np.flatnonzero(mask & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = mask[1:]
    last = off[1:] - 1
    nxt[last[last >= 0]] = False              # a row's last byte closes a word
    ends = np.flatnonzero(mask & ~nxt) + 1
    rows = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants), in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    if n:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return p


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _inverse_powers(n: int) -> np.ndarray:
    p = np.full(n, _INVERSE, np.uint64)
    if n:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return p


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: a prefix polynomial, then a finaliser with the length."""
    n = len(buf)
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[buf] * _powers(n), out=prefix[1:], dtype=np.uint64)
    value = (prefix[ends] - prefix[starts]) * _inverse_powers(n)[starts]
    return mix64(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    step[0] = starts[0]
    step[heads[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def release_memory() -> None:
    """Hands memory that this process has freed back to the system.

    Python workers live on from stage to stage; what their allocators keep counts against the executor while the
    next stage's workers need it.
    """
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                            # another C library than glibc
        pass


def returning_memory(run: Callable) -> Callable:
    """The generator function of a task, which releases memory when it has ended."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped
