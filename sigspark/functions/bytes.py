"""Byte-level features of file content (``BINARY`` column).

The hot loops (256-bin histogram, sliding-window byte/entropy histogram,
printable-run statistics) run as Arrow ``pandas_udf``s: each value is counted in
pieces of bounded size with numpy, so there is no per-byte Python loop and memory
does not grow with the size of a file or a batch.
Everything derived from the counts (entropy, normalisation, start bytes)
stays in JVM expressions.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the byte/entropy histogram (must equal the reference).
WINDOW = 2048
STEP = 1024


#: Bytes of one value that are counted at once, so memory does not grow with a file.
PIECE = 4 << 20


def _uint8(blob) -> np.ndarray:
    """A value (bytes, or the buffer of an Arrow value) as uint8, without a copy."""
    return np.frombuffer(blob if blob is not None else b"", dtype=np.uint8)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as one list for each row."""
    offsets = np.arange(rows.shape[0] + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _pieces(blob):
    """A value as uint8 arrays of bounded size (views, no copies)."""
    a = _uint8(blob)
    return [a[i:i + PIECE] for i in range(0, len(a), PIECE)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_histogram_udf(content: pa.Array) -> pa.Array:
    """256 raw byte counts per row (``ft_byte_histogram`` raw form)."""
    out = np.zeros((len(content), 256), dtype=np.int64)
    for counts, value in zip(out, content):
        for piece in _pieces(value.as_buffer()):
            counts += np.bincount(piece, minlength=256)
    return _lists(out)


@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_entropy_histogram_udf(content: pa.Array) -> pa.Array:
    """16x16 byte/entropy counts per row, flattened row-major (``ft_byte_entropy`` raw form).

    Windows of 2048 bytes every 1024 bytes; a file shorter than one window is
    a single short window whose probabilities are still divided by 2048.
    Entropy bin = int(2 * 2 * H4) where H4 is the entropy of the high nibbles,
    clamped to 15. Computed in float32 like the reference.
    """
    out = np.zeros((len(content), 256), dtype=np.int64)
    for r, value in enumerate(content):
        a = _uint8(value.as_buffer())
        if a.shape[0] == 0:
            continue
        if a.shape[0] < WINDOW:
            c = np.bincount(a >> 4, minlength=16).reshape(1, 16)
        else:
            c = _window_nibble_counts(a)
        p = c.astype(np.float32) / np.float32(WINDOW)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(c > 0, -p * np.log2(np.where(c > 0, p, np.float32(1))), np.float32(0))
        h = terms.sum(axis=1, dtype=np.float32) * np.float32(2)
        hbin = np.minimum((h * np.float32(2)).astype(np.int64), 15)
        np.add.at(out[r].reshape(16, 16), hbin, c)
    return _lists(out)


def _window_nibble_counts(a: np.ndarray, piece: int = 1 << 24) -> np.ndarray:
    """(n_windows, 16) high-nibble counts of every 2048-byte window at step 1024.

    A window is two consecutive 1024-byte chunks, so chunk counts are computed
    once (in bounded pieces of the file) and neighbouring chunks are added.
    """
    nfull = a.shape[0] // STEP
    chunks = np.empty((nfull, 16), dtype=np.int64)
    for lo in range(0, nfull, piece // STEP):
        hi = min(nfull, lo + piece // STEP)
        nib = a[lo * STEP:hi * STEP] >> 4
        ids = np.repeat(np.arange(hi - lo, dtype=np.int64), STEP) * 16 + nib
        chunks[lo:hi] = np.bincount(ids, minlength=(hi - lo) * 16).reshape(hi - lo, 16)
    return chunks[:-1] + chunks[1:]


_PRINTABLE_SCHEMA = T.StructType([
    T.StructField("numstrings", T.LongType()),
    T.StructField("avlength", T.DoubleType()),
    T.StructField("printables", T.LongType()),
    T.StructField("printabledist", T.ArrayType(T.LongType())),
    T.StructField("entropy", T.DoubleType()),
])


def printable_runs(blob) -> tuple[int, int, np.ndarray]:
    """(runs, their bytes, counts of the 96 printable values) over runs of >= 5 bytes in 0x20..0x7f.

    A run that is open at the end of a piece is carried on as a length and counts.
    """
    runs, dist = 0, np.zeros(96, dtype=np.int64)
    open_len, open_counts = 0, np.zeros(96, dtype=np.int64)
    for piece in _pieces(blob):
        mask = (piece >= 0x20) & (piece <= 0x7F)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        if open_len and (not len(starts) or starts[0] > 0):      # the open run ended with the last piece
            if open_len >= 5:
                runs, dist = runs + 1, dist + open_counts
            open_len, open_counts = 0, np.zeros(96, dtype=np.int64)
        if not len(starts):
            continue
        if open_len:                                             # it goes on at the start of this one
            open_len += int(ends[0])
            open_counts = open_counts + np.bincount(piece[:ends[0]] - 0x20, minlength=96)
            starts, ends = starts[1:], ends[1:]
            if open_len and len(piece) > (edges[1] if len(edges) > 1 else 0):
                if open_len >= 5:
                    runs, dist = runs + 1, dist + open_counts
                open_len, open_counts = 0, np.zeros(96, dtype=np.int64)
        if len(ends) and ends[-1] == len(piece):                 # the last run stays open
            open_len = int(ends[-1] - starts[-1])
            open_counts = np.bincount(piece[starts[-1]:] - 0x20, minlength=96)
            starts, ends = starts[:-1], ends[:-1]
        keep = ends - starts >= 5
        runs += int(keep.sum())
        inside = np.zeros(len(piece) + 1, dtype=np.int8)
        inside[starts[keep]] = 1
        inside[ends[keep]] -= 1
        kept = piece[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        dist = dist + np.bincount(kept - 0x20, minlength=96)
    if open_len >= 5:
        runs, dist = runs + 1, dist + open_counts
    return runs, int(dist.sum()), dist


@F.arrow_udf(_PRINTABLE_SCHEMA)
def printable_stats_udf(content: pa.Array) -> pa.Array:
    """Statistics of runs of >= 5 bytes in 0x20..0x7f (``ft_strings`` raw scalars)."""
    found = [printable_runs(value.as_buffer()) for value in content]
    numstrings = np.array([f[0] for f in found], dtype=np.int64)
    printables = np.array([f[1] for f in found], dtype=np.int64)
    dist = np.array([f[2] for f in found], dtype=np.int64).reshape(len(found), 96)
    with np.errstate(divide="ignore", invalid="ignore"):
        avlength = np.where(numstrings > 0, printables / np.maximum(numstrings, 1), 0.0)
        p = dist.astype(np.float32) / np.maximum(printables, 1)[:, None].astype(np.float32)
        terms = np.where(dist > 0, -p * np.log2(np.where(dist > 0, p, np.float32(1))), np.float32(0))
    entropy = terms.sum(axis=1, dtype=np.float32).astype(np.float64)
    return pa.StructArray.from_arrays(
        [pa.array(numstrings), pa.array(avlength.astype(np.float64)), pa.array(printables), _lists(dist), pa.array(entropy)],
        names=["numstrings", "avlength", "printables", "printabledist", "entropy"])


# ---- JVM-side expressions over the counts -------------------------------------------------

def _over_total(counts: Column) -> Column:
    """counts / sum(counts) with the sum evaluated once (a total referenced
    inside a lambda would be re-evaluated for every element)."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.zip_with(counts, F.array_repeat(total, F.size(counts)), lambda x, t: F.try_divide(x, t))


def entropy_from_counts(counts: Column) -> Column:
    """Shannon entropy (base 2) of a count array (``fn_entropy``); 0 for empty input."""
    probs = F.filter(_over_total(counts), lambda p: p > 0)
    return F.coalesce(F.aggregate(probs, F.lit(0.0).cast("double"), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0))


def normalize_counts(counts: Column) -> Column:
    """counts / sum(counts) as float (``vec`` form of histogram blocks); zeros for a zero total."""
    return F.transform(_over_total(counts), lambda x: F.coalesce(x, F.lit(0.0)).cast("float"))


def start_bytes(content: Column) -> Column:
    """First four bytes as ints, zero-padded (``general.start_bytes``)."""
    return F.array(*[
        F.coalesce(F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("int"), F.lit(0))
        for i in range(1, 5)
    ])


def is_pe_guess(content: Column) -> Column:
    """1 when the bytes carry an MZ header whose e_lfanew points at 'PE\\0\\0'."""
    lfanew = F.conv(F.concat(*[F.hex(F.substring(content, 61 + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("bigint")
    # a hostile offset points behind the end: bounded before the cast, it finds nothing there
    sig = F.hex(F.substring(content, (F.least(lfanew, F.length(content).cast("bigint")) + 1).cast("int"), 4))
    return F.when(
        (F.hex(F.substring(content, 1, 2)) == "4D5A") & (F.length(content) >= 64) & (sig == "50450000"), 1
    ).otherwise(0)


def general_block(content: Column, histogram: Column) -> Column:
    """``ft_general`` raw struct: size, entropy, is_pe, start_bytes."""
    return F.struct(
        F.length(content).cast("bigint").alias("size"),
        entropy_from_counts(histogram).alias("entropy"),
        is_pe_guess(content).alias("is_pe"),
        start_bytes(content).alias("start_bytes"),
    )
