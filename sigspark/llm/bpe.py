"""Byte-pair encoding and decoding of whole texts, long unsplit runs by tree concatenation.

Ordinary documents are encoded row by row (``tokenization``). A document above
``segment_bytes`` is dealt out as segments that end at pre-token borders. A
pre-token longer than ``leaf_bytes`` (text without any border, such as a line of
one letter or unspaced script) is cut in halves until they are short; the leaves
are encoded in parallel, and joined pairwise up the tree: around each join a
growing window of tokens is encoded again until its first and last token
agree with what stands there already. A sequence of tokens is the encoding of
its text exactly if each neighbouring pair is the encoding of its own text,
so agreement on both sides makes the joined ids exact.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.frames import TMP
from sigspark.llm.text import column_buffer, slices
from sigspark.llm.tokenization import TextEncoder, piece_borders, worker_encoder


def _binary_rows(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(flat, dtype="<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1,
                                 [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


class RunCodec:
    """Encodes any byte run of one pre-token with the library's model, and joins such encodings."""

    def __init__(self, encoder: TextEncoder):
        self.encoder = encoder
        self.model = encoder.tokenizer.model
        code = {c: b for b, c in enumerate(encoder.alphabet)}
        self.token_bytes = {i: bytes(code[c] for c in t) for t, i in encoder.tokenizer.get_vocab(False).items()}

    def encode(self, data: bytes) -> list[int]:
        alphabet = self.encoder.alphabet
        return [t.id for t in self.model.tokenize("".join([alphabet[b] for b in data]))] if data else []

    def text(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def join(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """Ids of the concatenated texts of two encodings."""
        if not left or not right:
            return left or right
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            middle = self.encode(self.text(left[-a:]) + self.text(right[:b]))
            fits_left = a == len(left) or middle[0] == left[-a]
            fits_right = b == len(right) or middle[-1] == right[b - 1]
            if fits_left and fits_right:
                return left[:-a] + middle + right[b:]
            window *= 2


_CODECS: dict[str, RunCodec] = {}


def worker_codec(path: str) -> RunCodec:
    if path not in _CODECS:
        _CODECS[path] = RunCodec(worker_encoder(path))
    return _CODECS[path]


def _cut_document(encoder: TextEncoder, data: bytes, segment_bytes: int, leaf_bytes: int):
    """(run, leaf, bytes) parts in text order; run -1 is a segment of ordinary text."""
    buf = np.frombuffer(data, np.uint8)
    if encoder.special is not None and encoder.special.search(data):
        return [(-1, 0, data)]                           # the library places special tokens itself
    starts = piece_borders(buf, np.array([0, len(buf)], np.int64))
    ends = np.append(starts[1:], len(buf))
    long = ends - starts > leaf_bytes
    parts: list[tuple[int, int, bytes]] = []
    run = 0
    pending = 0                                          # start of ordinary text not yet given out

    def ordinary(end: int) -> None:
        nonlocal pending
        while pending < end:
            stop = end
            if end - pending > segment_bytes:
                stop = int(starts[np.searchsorted(starts, pending + segment_bytes, side="right") - 1])
                stop = stop if pending < stop < end else int(ends[np.searchsorted(starts, pending, side="right") - 1])
            parts.append((-1, 0, data[pending: stop]))
            pending = stop

    for at in np.flatnonzero(long):
        a, b = int(starts[at]), int(ends[at])
        ordinary(a)
        text = data[a:b].decode("utf-8")
        for _, (i, j) in encoder.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            token = text[i:j].encode("utf-8")
            if len(token) <= leaf_bytes:
                parts.append((-2, 0, token))             # one short pre-token beside a long one
                continue
            leaves = [token]
            while max(map(len, leaves)) > leaf_bytes:
                leaves = [h for x in leaves for h in (x[: len(x) // 2], x[len(x) // 2:])]
            parts.extend((run, k, x) for k, x in enumerate(leaves))
            run += 1
        pending = b
    ordinary(len(data))
    return parts


def ids_as_binary(tokenizer: str, ids: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    return [_binary_rows(ids, off)]


def encode_documents(docs: DataFrame, tokenizer: str, doc_col: str = "doc_id", text_col: str = "text",
                     segment_bytes: int = 64 << 10, leaf_bytes: int = 2 << 10,
                     finish=ids_as_binary, finish_schema: str = "ids binary") -> DataFrame:
    """doc and ids (little-endian unsigned 32-bit) of every document.

    ``finish(tokenizer, ids, row offsets)`` may turn a batch's ids into other
    columns (``finish_schema``) in the same pass.

    Null or empty text has no ids. Repeated rows come out once each. Ids equal
    those of the library's encoder with add_special_tokens=False. The tokenizer
    must be byte-level without a normaliser.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_col].dataType.simpleString()
    base = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > segment_bytes, F.lit(False))

    names = ["doc", *[c.split()[0] for c in finish_schema.split(", ")]]

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *finish(tokenizer, *encoder.encode_column(batch.column(1)))], names=names)

    short = base.filter(~is_long).mapInArrow(encode_rows, f"doc {kind}, {finish_schema}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, off = column_buffer(batch.column(2))
                for r in range(batch.num_rows):
                    parts = _cut_document(encoder, buf[off[r]: off[r + 1]].tobytes(), segment_bytes, leaf_bytes)
                    n = len(parts)
                    runs = [p[0] for p in parts]
                    leaves = np.bincount(np.array([x for x in runs if x >= 0], np.int64), minlength=1)
                    first: dict[int, int] = {}
                    seq = [first.setdefault(x, i) if x >= 0 else i for i, x in enumerate(runs)]
                    at = pa.array([r] * n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(seq, pa.int32()),
                         pa.array([p[1] for p in parts], pa.int32()),
                         pa.array([int(leaves[x]) if x >= 0 else 0 for x in runs], pa.int32()),
                         pa.array([x >= -1 and x < 0 for x in runs]), pa.array([p[2] for p in parts], pa.binary())],
                        names=["doc", "row", "seq", "leaf", "leaves", "plain", "data"])

    parts = (base.filter(is_long).withColumn("row", F.monotonically_increasing_id()).select("doc", "row", "text")
             .mapInArrow(cut, f"doc {kind}, row long, seq int, leaf int, leaves int, plain boolean, data binary"))
    most = parts.agg(F.max("leaves")).first()[0]
    if most is None:
        return short

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer)
        for batch in batches:
            plain = batch.column(5).to_pylist()
            ids = []
            for is_plain, data in zip(plain, batch.column(6).to_pylist()):
                if is_plain:
                    got, _ = codec.encoder.encode_column(pa.array([data.decode("utf-8")]))
                else:
                    got = np.array(codec.encode(data), np.int32)
                ids.append(got.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())],
                                             names=["doc", "row", "seq", "leaf", "leaves", "ids"])

    coded = (parts.repartition("row", "seq", "leaf")
             .mapInArrow(encode_parts, f"doc {kind}, row long, seq int, leaf int, leaves int, ids binary"))

    def join_two(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = worker_codec(tokenizer)
        pdf = pdf.sort_values("leaf", kind="stable")
        both = [np.frombuffer(x, "<u4").tolist() for x in pdf["ids"]]
        ids = both[0] if len(both) == 1 else codec.join(both[0], both[1])
        out = pdf.iloc[:1].copy()
        out["leaf"] = out["leaf"] // 2
        out["leaves"] = (out["leaves"] + 1) // 2
        out["ids"] = [np.array(ids, "<u4").tobytes()]
        return out

    done = coded.filter(F.col("leaves") <= 1).drop("leaves")
    tree = coded.filter(F.col("leaves") > 1)
    while most > 1:                                      # one round for each level of the tallest tree
        tree = tree.groupBy("row", "seq", (F.col("leaf") / 2).cast("int").alias(TMP + "node")).applyInPandas(
            join_two, coded.schema)
        most = (most + 1) // 2
        if most == 1:
            done = done.unionByName(tree.drop("leaves"))

    def whole_document(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4")
        return pa.Table.from_arrays([table.column("doc").slice(0, 1), *finish(tokenizer, ids, np.array([0, len(ids)]))], names=names)

    # a group is one document, which was one value of the input
    long = done.groupBy("row").applyInArrow(whole_document, f"doc {kind}, {finish_schema}")
    return short.unionByName(long)


class Decoder:
    """Bytes of ids for byte-level vocabularies; special tokens give their own string."""

    def __init__(self, path: str):
        encoder = worker_encoder(path)
        codec = worker_codec(path)
        size = max([*codec.token_bytes, *encoder.tokenizer.get_added_tokens_decoder()]) + 1
        table = [codec.token_bytes.get(i, b"") for i in range(size)]
        for i, t in encoder.tokenizer.get_added_tokens_decoder().items():
            table[i] = t.content.encode("utf-8")
        self.table = pa.array(table, pa.large_binary())
        self.decimal = [str(i) for i in range(size)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of rows of ids; bytes that are not UTF-8 become the replacement character."""
        taken = self.table.take(pa.array(ids, pa.int64()))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[taken.offset: taken.offset + len(taken) + 1][off]
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_DECODERS: dict[str, Decoder] = {}


def worker_decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def id_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets) of a binary id column."""
    buf, off = column_buffer(column)
    return np.frombuffer(buf.tobytes(), "<u4"), off // 4


def decode_documents(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc and text of every row of ``encode_documents``."""
    kind = coded.schema["doc"].dataType.simpleString()

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                texts = worker_decoder(tokenizer).decode(*id_rows(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    return coded.mapInArrow(decode_rows, f"doc {kind}, text string")


DIGEST_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_rows(tokenizer: str, ids: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """n_tokens, sha256 of the decimal ids joined by commas, and sha256 of the decoded text of each row."""
    decoder = worker_decoder(tokenizer)
    texts = decoder.decode(ids, off)
    shas = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        sha = hashlib.sha256()
        for at in range(a, b, 1 << 16):
            sha.update(("," if at > a else "").encode())
            sha.update(",".join([decoder.decimal[i] for i in ids[at: min(b, at + (1 << 16))].tolist()]).encode())
        shas.append(sha.hexdigest())
    return [pa.array(np.diff(off), pa.int64()), pa.array(shas, pa.string()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())]


def digests(docs: DataFrame, tokenizer: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode_documents(docs, tokenizer, doc_col, text_col, finish=digest_rows, finish_schema=DIGEST_SCHEMA)
