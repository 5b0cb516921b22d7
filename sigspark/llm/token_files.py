"""Token-id files of patched frame-of-reference blocks.

File layout (all numbers little-endian):

* header: magic ``PFOR``, block length (u32), ids (u64), blocks (u32), documents (u32)
* block index: blocks + 1 byte positions (u64), counted from the first block
* document table: doc id (i64), null flag (u8), number of ids (u64), each as one array
* blocks: minimum (u32), width (u8), exceptions (u16), packed values, then the
  exceptions' places (u16 each) and values above the minimum (u32 each)

A block subtracts its minimum and packs the differences at the width that
``percentile`` of them need; wider ones are exceptions. The block index allows
any range of ids to be read without the blocks before it.

Spark's writer puts the files into the shared folder as binary values, so a
lost executor leaves no half-written file behind, and Spark's reader brings
them back from any store.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.text import slices
from sigspark.llm.tokenization import worker_encoder
from sigspark.session import scratch_path

MAGIC = b"PFOR"
_HEADER = struct.Struct("<4sIQII")
_BLOCK = struct.Struct("<IBH")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width, packed without gaps; groups of 64 fill ``width`` words."""
    if width == 0 or len(values) == 0:
        return b""
    lanes = np.zeros((-(-len(values) // 64), 64), np.uint64)
    lanes.ravel()[: len(values)] = values
    words = np.zeros((len(lanes), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, np.uint64)
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    lanes = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        lane = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | (words[:, at + 1] << np.uint64(64 - shift))
        lanes[:, j] = lane & mask
    return lanes.ravel()[:n]


def _packed_bytes(n: int, width: int) -> int:
    return -(-n // 64) * width * 8


def write_blocks(ids: np.ndarray, block: int, percentile: float) -> tuple[np.ndarray, list[bytes]]:
    """Block start positions (one more than blocks) and the blocks' bytes."""
    n = len(ids)
    if n == 0:
        return np.zeros(1, np.uint64), []
    count = -(-n // block)
    padded = np.empty(count * block, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    grid = padded.reshape(count, block)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    cut = np.partition(diff, at, axis=1)[:, at].astype(np.uint64)
    width = np.zeros(count, np.int64)
    for bit in range(32):
        width += cut >= np.uint64(1 << bit)
    wide = diff.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    packed: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():                  # blocks of one width are packed together
        rows = np.flatnonzero(width == w)
        size = _packed_bytes(block, w)
        if block % 64:
            for r in rows.tolist():
                packed[r] = pack_bits(np.where(wide[r], 0, diff[r]), w)
        else:
            data = pack_bits(np.where(wide[rows], 0, diff[rows]).ravel(), w)
            for i, r in enumerate(rows.tolist()):
                packed[r] = data[i * size: (i + 1) * size]
    out, starts = [], np.zeros(count + 1, np.uint64)
    total = 0
    exceptions = wide.any(axis=1)
    for r in range(count):
        places = np.flatnonzero(wide[r]) if exceptions[r] else np.zeros(0, np.int64)
        raw = b"".join((_BLOCK.pack(int(low[r]), int(width[r]), len(places)), packed[r],
                        places.astype("<u2").tobytes(), diff[r][places].astype("<u4").tobytes()))
        out.append(raw)
        total += len(raw)
        starts[r + 1] = total
    return starts, out


def write_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = 1024,
               percentile: float = 0.95) -> bytes:
    """One file with the ids of some documents in order."""
    if not 1 <= block <= 65535:
        raise ValueError("a block holds 1 to 65535 ids")
    starts, blocks = write_blocks(ids, block, percentile)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([_HEADER.pack(MAGIC, block, len(ids), len(blocks), len(doc_ids)), starts.astype("<u8").tobytes(),
                     keys.tobytes(), nulls.tobytes(), np.asarray(sizes, "<u8").tobytes(), *blocks])


class TokenFile:
    """A file's documents and ids; ``ids(a, b)`` touches only the blocks of that range."""

    def __init__(self, data: bytes):
        self.data = data
        magic, self.block, self.n_ids, self.n_blocks, self.n_docs = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        self.index = np.frombuffer(data, "<u8", self.n_blocks + 1, at)
        at += 8 * (self.n_blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.nulls = np.frombuffer(data, np.uint8, self.n_docs, at).astype(bool)
        at += self.n_docs
        self.sizes = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        self.body = at + 8 * self.n_docs

    def _blocks(self, first: int, last: int) -> np.ndarray:
        out = np.empty((last - first, self.block), np.uint32)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        heads = []
        for b in range(first, last):
            at = self.body + int(self.index[b])
            low, width, n = _BLOCK.unpack_from(self.data, at)
            at += _BLOCK.size
            size = _packed_bytes(self.block, width)
            by_width.setdefault(width, []).append((b - first, self.data[at: at + size]))
            heads.append((low, n, at + size))
        for width, parts in by_width.items():
            rows = [r for r, _ in parts]
            per = -(-self.block // 64) * 64
            values = unpack_bits(b"".join(d for _, d in parts), width, per * len(rows))
            out[rows] = values.reshape(len(rows), per)[:, : self.block].astype(np.uint32)
        for r, (low, n, at) in enumerate(heads):
            if n:
                places = np.frombuffer(self.data, "<u2", n, at)
                out[r, places] = np.frombuffer(self.data, "<u4", n, at + 2 * n)
            out[r] += np.uint32(low)
        return out.ravel()

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-end // self.block)
        return self._blocks(first, last)[start - first * self.block: end - first * self.block]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, doc_col: str = "doc_id",
                      text_col: str = "text", block: int = 1024, percentile: float = 0.95,
                      file_ids: int = 2 << 20) -> str:
    """Encodes the documents, appends ``end_id`` to each, and writes files in ascending doc id order; the folder.

    Null doc ids come first, equal ids in order of their text. A file holds
    about ``file_ids`` ids at most (whole documents). Null or empty text is
    the end id alone; no documents give no file.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    ordered = (docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
               .repartitionByRange(F.col("doc")).sortWithinPartitions("doc", "text"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        docs_held: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, n
            data = write_file(docs_held, np.concatenate(sizes), np.concatenate(held), block, percentile)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([data], pa.binary())], names=["part", "number", "n_ids", "file"])
            number, n = number + 1, 0
            docs_held.clear()
            sizes.clear()
            held.clear()
            return row

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                flat, off = encoder.encode_column(batch.column(1))
                rows = batch.num_rows
                ids = np.full(len(flat) + rows, end_id, np.uint32)
                keep = np.ones(len(ids), bool)
                keep[off[1:] + np.arange(rows)] = False
                ids[keep] = flat
                docs_held.extend(batch.column(0).to_pylist())
                sizes.append(np.diff(off) + 1)
                held.append(ids)
                n += len(ids)
                if n >= file_ids:
                    yield flush()
        if docs_held:
            yield flush()

    ordered.mapInArrow(files, "part int, number int, n_ids long, file binary").write.parquet(path)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """doc, start (ids of all documents before), n_tokens and ids (little-endian u32) of every document."""
    files = spark.read.parquet(path)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (files.select("part", "number", "n_ids")         # one short row for each file
              .select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column(0), batch.column(1).to_pylist()):
                file = TokenFile(data.as_py())
                bounds = np.concatenate([[0], np.cumsum(file.sizes)])
                step = 4096
                for a in range(0, file.n_docs, step):
                    b = min(a + step, file.n_docs)
                    ids = file.ids(int(bounds[a]), int(bounds[b])).astype("<u4")
                    off = (bounds[a: b + 1] - bounds[a]) * 4
                    raw = ids.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[a:b], pa.int64(), mask=file.nulls[a:b]),
                         pa.array(bounds[a:b] + first, pa.int64()), pa.array(file.sizes[a:b], pa.int64()),
                         pa.array([raw[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())],
                        names=["doc", "start", "n_tokens", "ids"])

    return (files.join(firsts, ["part", "number"]).select("file", "first")
            .mapInArrow(rows, "doc long, start long, n_tokens long, ids binary"))
