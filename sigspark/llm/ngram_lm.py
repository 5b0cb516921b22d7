"""n-gram language model in Elias-Fano tries, built and asked in shards.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end token for each
text; a word is a 64-bit hash. The model is an interpolated bigram: absolute discounting
over a smoothed unigram,

    p(w | u) = max(c(u w) - d, 0) / c(u) + d * n(u) / c(u) * p(w),
    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The corpus is cut into blocks (a bounded stretch of one input partition). A
block sends each shard its distinct n-grams with their training counts, once:
these are both the counts to add up and the questions to answer. A shard holds
all n-grams of its contexts. It builds a trie whose levels are Elias-Fano
sequences in one memory-mapped file: contexts, pointers to their successors, and
successors made monotone across contexts; discounted probabilities and
interpolation weights are stored as one-byte codes on a fixed logarithmic grid.
Questions are answered by a successor search relative to the context. The
answers go back in question order, one byte for each bigram, and the block adds
up its documents. Nothing is broadcast and nothing that grows is collected; a
frequent n-gram is one entry of a block, however often it occurs.

Defined cases: null text counts as empty (its end token alone); texts whose
remainder is null are neither held out nor learned from; without training
tokens every count is 0 and p(w) = 1 / (V + 1) = 1; repeated rows count and come
out once each.
"""
from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.frames import written
from sigspark.llm.text import column_buffer, lower_ascii, mix64, slices, span_hashes, word_spans

#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: Discount of every n-gram count.
DISCOUNT = 0.75
#: Codes 1..254 stand for 10 ** -(code - 1) * STEP; 0 for nothing stored.
STEP = 12.0 / 253

_START = np.uint64(0x9AE16A3B2F90404F)
_END = np.uint64(0xC949D7C7509E6557)
_WORD_BITS = 48


def quantise(p: np.ndarray) -> np.ndarray:
    """One-byte codes of probabilities: nearest point of the logarithmic grid, 0 for 0."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint(-np.log10(p) / STEP)
    return np.where(p > 0, np.clip(code, 1, 254), 0).astype(np.uint8)


def expand(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** (-(code.astype(np.float64) - 1) * STEP))


class EliasFano:
    """A non-decreasing sequence of whole numbers: packed low bits and a unary high-bit array."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._buckets: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        if n == 0:
            return EliasFano(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        bits = max(0, int(math.floor(math.log2(max(1.0, (int(values[-1]) + 1) / n)))))
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(int(high[-1]) + n + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        low = values & np.uint64((1 << bits) - 1)
        columns = [((low >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8) for b in range(-(-bits // 8))]
        packed = np.concatenate(columns) if columns else np.zeros(0, np.uint8)
        return EliasFano(n, bits, packed, np.packbits(unary))

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for b in range(-(-self.low_bits // 8)):
            out |= self.low[b * self.n + at].astype(np.uint64) << np.uint64(8 * b)
        return out

    def _starts(self) -> np.ndarray:
        """First place of each high value, from the zeros of the unary array."""
        if self._buckets is None:
            zeros = np.flatnonzero(np.unpackbits(self.high) == 0)
            self._buckets = np.concatenate([[0], zeros - np.arange(len(zeros))])
        return self._buckets

    def get(self, at: np.ndarray) -> np.ndarray:
        starts = self._starts()
        high = np.searchsorted(starts, at, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element >= x (n if there is none): the bucket of the high bits, then its low bits."""
        x = x.astype(np.uint64)
        starts = self._starts()
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        beyond = high >= len(starts) - 1
        high = np.minimum(high, max(0, len(starts) - 2))
        if self.n == 0:
            return np.zeros(len(x), np.int64)
        lo, hi = np.minimum(starts[high], self.n), np.minimum(starts[high + 1], self.n)
        want = x & np.uint64((1 << self.low_bits) - 1)
        while True:                                        # binary search in the bucket, all questions at once
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        lo[beyond] = self.n
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, or -1."""
        at = self.successor(x)
        ok = at < self.n
        got = np.full(len(at), -1, np.int64)
        if ok.any():
            inside = np.flatnonzero(ok)
            same = self.get(at[inside]) == x[inside].astype(np.uint64)
            got[inside[same]] = at[inside[same]]
        return got


class Trie:
    """Contexts, pointers and successors of one shard; the levels live in a memory-mapped file."""

    def __init__(self, contexts: np.ndarray, first: np.ndarray, successors: np.ndarray, counts: np.ndarray, discount: float):
        """Sorted contexts; successors of context i are ``successors[first[i]:first[i + 1]]``, sorted, with counts."""
        total = np.add.reduceat(counts, first[:-1]).astype(np.float64) if len(contexts) else np.zeros(0)
        kinds = np.diff(first)
        words = np.unique(successors)
        owner = np.repeat(np.arange(len(contexts)), kinds)
        rank = np.searchsorted(words, successors)
        self.width = np.uint64(max(1, len(words)))
        # context-relative: the context's number lifts its successors above all earlier ones
        lifted = owner.astype(np.uint64) * self.width + rank.astype(np.uint64)
        p = np.maximum(counts - discount, 0.0) / total[owner] if len(counts) else np.zeros(0)
        weight = discount * kinds / total if len(contexts) else np.zeros(0)
        parts = [EliasFano.encode(contexts), EliasFano.encode(first), EliasFano.encode(words), EliasFano.encode(lifted)]
        arrays = [a for e in parts for a in (e.low, e.high)] + [quantise(p), quantise(np.minimum(weight, 1.0))]
        sizes = [len(a) for a in arrays]
        self.file = tempfile.TemporaryFile(prefix="trie-")
        for a in arrays:
            self.file.write(a.tobytes())
        self.file.write(b"\0")                              # an empty file cannot be mapped
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        view = np.frombuffer(self.map, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        mapped = [view[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        levels = [EliasFano(e.n, e.low_bits, mapped[2 * i], mapped[2 * i + 1]) for i, e in enumerate(parts)]
        self.contexts, self.pointers, self.words, self.successors = levels
        self.codes, self.weights = mapped[8], mapped[9]

    def context(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, weight code of the lower order) of contexts; an unseen context leaves all to the lower order."""
        at = self.contexts.find(words)
        code = np.ones(len(words), np.uint8)
        code[at >= 0] = self.weights[at[at >= 0]]
        return at, code

    def bigram(self, place: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probability codes of successors of contexts at known places; 0 where nothing is stored."""
        rank = self.words.find(words)
        code = np.zeros(len(words), np.uint8)
        ask = np.flatnonzero((place >= 0) & (rank >= 0))
        if len(ask):
            x = place[ask].astype(np.uint64) * self.width + rank[ask].astype(np.uint64)
            at = self.successors.successor(x)
            bound = self.pointers.get(place[ask] + 1).astype(np.int64)      # the context's own stretch
            ok = np.flatnonzero(at < bound)
            hit = ok[self.successors.get(at[ok]) == x[ok]] if len(ok) else ok
            code[ask[hit]] = self.codes[at[hit]]
        return code


def _squeeze(*arrays: np.ndarray) -> list[bytes]:
    zip_ = zstandard.ZstdCompressor(level=1)
    return [zip_.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _expand(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _six_bytes(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, byte column by byte column."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)


def _from_six(data: bytes) -> np.ndarray:
    raw = _expand(data, np.uint8).reshape(6, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :6] = raw.T
    return out.view("<u8").ravel()


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(48)) % np.uint64(shards)).astype(np.int64)


class Block:
    """The tokens of some texts and their distinct words and bigrams, in an order that is the same each time."""

    def __init__(self, column: pa.Array, learned: np.ndarray, shards: int):
        buf, off = column_buffer(column)
        low = lower_ascii(buf)
        starts, ends, rows = word_spans(low, off, "space")
        n = len(off) - 1
        count = np.bincount(rows, minlength=n).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(count + 1)])
        tokens = np.empty(int(self.bounds[-1]), np.uint64)
        tokens[self.bounds[1:] - 1] = _END
        tokens[np.arange(len(rows)) + rows] = span_hashes(low, starts, ends)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.bounds[:-1]] = _START
        row_of = np.repeat(np.arange(n), count + 1)
        weight = learned[row_of]
        # words (as tokens or contexts), by shard and hash
        words = np.unique(np.append(tokens, _START) if n else tokens)
        order = np.argsort(shard_of(words, shards), kind="stable")
        self.words = words[order]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.token = place[np.searchsorted(words, tokens)]
        self.context = place[np.searchsorted(words, before)]
        self.word_counts = np.bincount(self.token, weights=weight, minlength=len(words)).astype(np.int64)
        # bigrams by context place and word
        pair = (self.context.astype(np.uint64) << np.uint64(32)) | self.token.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        head = np.ones(len(pair), bool)
        head[1:] = pair[by][1:] != pair[by][:-1]
        number = np.cumsum(head) - 1
        self.pair = np.empty(len(pair), np.int64)
        self.pair[by] = number
        at = by[head]
        self.pair_context, self.pair_word = self.context[at].astype(np.int32), self.token[at].astype(np.int32)
        self.pair_counts = np.bincount(self.pair, weights=weight, minlength=len(at)).astype(np.int32)
        del self.context, self.token, pair, by, number, tokens, before
        shard = shard_of(self.words, shards)
        self.word_bounds = np.searchsorted(shard, np.arange(shards + 1))
        self.pair_bounds = np.searchsorted(self.pair_context, self.word_bounds)
        self.n_tokens, self.n_learned = count + 1, int(weight.sum())

    def questions(self, shard: int) -> list[bytes]:
        a, b = self.word_bounds[shard], self.word_bounds[shard + 1]
        c, d = self.pair_bounds[shard], self.pair_bounds[shard + 1]
        kinds = np.bincount(self.pair_context[c:d] - a, minlength=b - a)
        return _squeeze(self.words[a:b].astype("<u8"), self.word_counts[a:b].astype("<u4"), kinds.astype("<u4"),
                        _six_bytes(self.words[self.pair_word[c:d]]), self.pair_counts[c:d].astype("<u4"))


def _blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    """Blocks of a task's rows in order, numbered; batches are put together up to the block size."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        nonlocal number, size
        table = pa.Table.from_batches(held).combine_chunks()
        batch = table.to_batches()[0]
        block = Block(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), shards)
        key = (part << 24) | number
        number, size = number + 1, 0
        held.clear()
        return key, batch, block

    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES // 4):
            held.append(batch)
            size += int(column_buffer(batch.column(0))[1][-1])
            if size >= BLOCK_BYTES:
                yield flush()
    if held:
        yield flush()


def score(docs: DataFrame, learn: Column, carry: dict[str, Column] | None = None, text_col: str = "text",
          shards: int | None = None, discount: float = DISCOUNT) -> DataFrame:
    """The columns of ``carry``, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    ``learn`` marks the rows to learn from. ``docs`` must give the same rows in the same
    partitions when read twice (a file scan or a written table).
    """
    spark = docs.sparkSession
    carry = carry or {}
    shards = shards or max(12, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).cast("int").alias("learned"),
                       *[c.alias(name) for name, c in carry.items()])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, block in _blocks(batches, shards):
            for first in range(0, shards, 64):
                rows = [block.questions(s) for s in range(first, min(first + 64, shards))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + len(rows)), pa.int32()), pa.array([key] * len(rows), pa.int64()),
                     *[pa.array(c, pa.binary()) for c in zip(*rows)]],
                    names=["shard", "block", "words", "word_counts", "kinds", "successors", "pair_counts"])

    questions = base.select("text", "learned").mapInArrow(
        ask, "shard int, block long, words binary, word_counts binary, kinds binary, successors binary, pair_counts binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        words = [_expand(x, "<u8") for x in pdf["words"]]
        kinds = [_expand(x, "<u4").astype(np.int64) for x in pdf["kinds"]]
        after = [_from_six(x) for x in pdf["successors"]]
        every = np.unique(np.concatenate(words))
        counts = np.zeros(len(every), np.int64)
        for w, x in zip(words, pdf["word_counts"]):
            counts[np.searchsorted(every, w)] += _expand(x, "<u4")
        # trained bigrams of all blocks, by context and word
        context, word, number = [], [], []
        for w, k, a, x in zip(words, kinds, after, pdf["pair_counts"]):
            c = _expand(x, "<u4")
            seen = c > 0
            context.append(np.repeat(np.searchsorted(every, w), k)[seen].astype(np.int32))
            word.append(a[seen])
            number.append(c[seen])
        context, word, number = np.concatenate(context), np.concatenate(word), np.concatenate(number)
        by = np.lexsort((word, context))
        context, word, number = context[by], word[by], number[by]
        head = np.ones(len(by), bool)
        head[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(head)
        number = np.add.reduceat(number.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        context, word = context[at], word[at]
        own, first = np.unique(context, return_index=True)
        del by, head
        trie = Trie(every[own], np.append(first, len(context)), word, number, discount)
        out = []
        for key, w, k, a in zip(pdf["block"], words, kinds, after):
            place, weight = trie.context(w)
            codes = trie.bigram(np.repeat(place, k), a)
            out.append((key, int(pdf["shard"].iloc[0]), *_squeeze(counts[np.searchsorted(every, w)].astype("<i8"), weight, codes)))
        shard = int(pdf["shard"].iloc[0])
        out.append((-1, shard, *_squeeze(np.array([counts.sum(), (counts > 0).sum()], "<i8")), b"", b""))
        return pd.DataFrame(out, columns=["block", "shard", "counts", "weights", "codes"])

    answers = written(questions.groupBy("shard").applyInPandas(
        answer, "block long, shard int, counts binary, weights binary, codes binary"), "answers")
    # two totals from each shard
    totals = [_expand(bytes(r[0]), "<i8") for r in answers.filter("block = -1").select("counts").collect()]
    n_train, n_vocab = (int(sum(t[i] for t in totals)) for i in range(2))
    floor = n_train + 0.5 * (n_vocab + 1)

    # each block's tokens as numbers into its distinct words and bigrams, to meet the answers
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch, block in _blocks(batches, shards):
            data = _squeeze(block.bounds.astype("<i8"), block.pair.astype("<u4"), block.pair_context.astype("<u4"), block.pair_word.astype("<u4"))
            sink = pa.BufferOutputStream()
            carried = batch.select(list(range(2, batch.num_columns)))
            with pa.ipc.new_stream(sink, carried.schema) as writer:
                writer.write_batch(carried)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), *[pa.array([x], pa.binary()) for x in data], pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["block", "bounds", "pair", "pair_context", "pair_word", "rows"])

    blocks = base.mapInArrow(numbered, "block long, bounds binary, pair binary, pair_context binary, pair_word binary, rows binary")
    schema = base.drop("text", "learned").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def add_up(block: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("shard")
        counts = np.concatenate([_expand(x.as_py(), "<i8") for x in replies.column("counts")])
        weight = expand(np.concatenate([_expand(x.as_py(), np.uint8) for x in replies.column("weights")]))
        codes = expand(np.concatenate([_expand(x.as_py(), np.uint8) for x in replies.column("codes")]))
        bounds, pair, context, word = (_expand(block.column(i)[0].as_py(), kind) for i, kind in ((1, "<i8"), (2, "<u4"), (3, "<u4"), (4, "<u4")))
        if len(codes) != len(word):
            raise RuntimeError("the input's partitions changed between two reads; write it to the shared folder first")
        low = (counts + 0.5) / floor
        base_log = np.log10(low)[word]
        model_log = np.log10(np.minimum(codes + weight[context] * low[word], 1.0))
        known = (counts > 0)[word].astype(np.int64)
        sums = [np.add.reduceat(x[pair], bounds[:-1]) for x in (known, base_log, model_log)]
        rows = pa.ipc.open_stream(block.column(5)[0].as_py()).read_all()
        n = len(bounds) - 1
        return pa.Table.from_arrays(
            [*rows.columns, pa.array(np.diff(bounds), pa.int64()), pa.array(sums[0], pa.int64()),
             pa.array(np.full(n, n_train), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
            names=[*rows.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kept = answers.filter("block >= 0")
    return blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(add_up, schema)
