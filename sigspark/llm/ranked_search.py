"""Ranked lexical search with range-maximum tables on posting lists.

Terms are runs of digits, ASCII letters (lower-cased) and characters beyond
ASCII. The terms of the items, which are the stated query set, form the
vocabulary: at most ``ITEMS_AT_ONCE`` items and ``ITEM_BYTES`` bytes of item text
are asked in one pass over the documents, further items in further passes.

One narrow pass over the whole texts writes the index: blocks of documents in
ascending id, each with its posting lists (document, occurrences) and document
lengths. Counts over all blocks give the weights, and weights and lengths give
every posting its impact, a whole number. For each posting list a sparse table
keeps the place of the largest impact of every run of 1, 2, 4, ... postings, so
the maximum of any range of documents takes two look-ups.

A block answers an item best-first: the sum of its terms' range maxima bounds
the score of every document of an interval. The intervals with the highest
bounds are taken (some at a time, so that numpy looks them all up at once); each is split
at its document of maximum impact, which is scored exactly, and the two rest
intervals get bounds of their own. Intervals that cannot reach the k best known
so far are dropped; these carry over from block to block of a task. A task emits
its k best documents of each item, and one rank over those ends the search.

Defined cases: null and empty texts hold no terms and do not count as documents;
items without terms give no rows; repeated items are answered each; a null
document id comes before all others among ties; repeated documents are separate
results; empty tables give no rows; other columns of the tables are ignored. Long
texts are read in pieces of ``PIECE_BYTES``; terms are compared by 64-bit hashes.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.frames import TMP, written
from sigspark.llm.text import column_buffer, lower_ascii, span_hashes, word_spans

#: Bounds of what one pass broadcasts.
ITEMS_AT_ONCE = 4096
ITEM_BYTES = 8 << 20
#: A block is closed at either.
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 19
PIECE_BYTES = 1 << 20
#: Intervals taken from the frontier at once.
TAKEN = 192

_FIRST = np.iinfo(np.int64).min


def _is_word(b: np.ndarray) -> np.ndarray:
    return ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def _words(buf: np.ndarray, off: np.ndarray, longest: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, row and hash of every word of at most ``longest`` bytes) piece by piece.

    A row above ``limit`` bytes is cut where a word ends, or inside a word that is too long to be a term.
    """
    row, rows = 0, len(off) - 1
    while row < rows:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        parts = [(int(off[row]), int(off[end]))] if end > row else []
        if end <= row:
            end, at, stop = row + 1, int(off[row]), int(off[row + 1])
            while at < stop:
                to = min(stop, at + limit)
                gaps = np.flatnonzero(~_is_word(lower_ascii(buf[to: to + longest + 1])))
                to = min(stop, to + (int(gaps[0]) if len(gaps) else longest + 1))
                parts.append((at, to))
                at = to
        for a, b in parts:
            piece = lower_ascii(buf[a:b])
            inner = np.clip(off[row: end + 1], a, b) - a
            start, stop_, of = word_spans(piece, inner)
            count = np.bincount(of, minlength=end - row)
            if a > off[row] and len(start) and start[0] == 0 and _is_word(lower_ascii(buf[a - 1: a]))[0]:
                count[0] -= 1                                     # the rest of a word that was counted before
                start, stop_, of = start[1:], stop_[1:], of[1:]
            short = stop_ - start <= longest
            yield row, count, of[short], span_hashes(piece, start[short], stop_[short])
        row = end


def terms_of(texts: list[str | None]) -> tuple[list[np.ndarray], int]:
    """(hashes of the distinct terms of each text, length of the longest term)."""
    out: list[np.ndarray] = []
    longest = 0
    for text in texts:
        buf, off = column_buffer(pa.array([text], pa.string()))
        piece = lower_ascii(buf)
        start, end, _ = word_spans(piece, off)
        longest = max(longest, int((end - start).max(initial=0)))
        out.append(np.unique(span_hashes(piece, start, end)))
    return out, longest


BLOCK_SCHEMA = "docs array<long>, lengths binary, term binary, at binary, times binary"


def index(docs: DataFrame, vocabulary: np.ndarray, longest: int, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with the posting lists of a sorted vocabulary of term hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def close(ids: list, lengths: list, found: list) -> pa.RecordBatch:
        key = np.array([_FIRST if i is None else i for i in ids], np.int64)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, at, times = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        one = term * len(ids) + place[at]
        sort = np.argsort(one, kind="stable")
        one, times = one[sort], times[sort]
        head = np.flatnonzero(np.diff(one, prepend=-1))           # the pieces of one text are added up
        times = np.add.reduceat(times, head) if len(head) else times
        one = one[head]
        n = np.array(lengths, np.int64)[order]
        columns = [n, (one // len(ids)).astype("<i4"), (one % len(ids)).astype("<i4"), times.astype("<i4")]
        return pa.RecordBatch.from_arrays(
            [pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
            names=["docs", "lengths", "term", "at", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        ids: list = []
        lengths: list[int] = []
        found: list[tuple] = []
        postings = 0
        for batch in batches:
            buf, off = column_buffer(batch.column(1))
            known = batch.column(0).to_pylist()
            for row, count, of, hashes in _words(buf, off, longest, PIECE_BYTES):
                new = len(ids) and row < done                     # a long text goes on
                if not new:
                    if len(ids) + len(count) > BLOCK_DOCS or postings > BLOCK_POSTINGS:
                        if ids:
                            yield close(ids, lengths, found)
                        ids, lengths, found, postings = [], [], [], 0
                    base = len(ids)
                    ids += known[row: row + len(count)]
                    lengths += count.tolist()
                else:
                    base = len(ids) - 1
                    lengths[-1] += int(count[0])
                done = row + len(count)
                t = np.searchsorted(vocab, hashes)
                hit = t < len(vocab)
                hit[hit] = vocab[t[hit]] == hashes[hit]
                one, times = np.unique((of[hit] + base) * len(vocab) + t[hit], return_counts=True)
                found.append((one % max(1, len(vocab)), one // max(1, len(vocab)), times))
                postings += len(one)
            done = 0
        if ids:
            yield close(ids, lengths, found)

    named = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, BLOCK_SCHEMA)


class PostingLists:
    """The posting lists of one block with a sparse table of range maxima."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, at: np.ndarray, impact: np.ndarray):
        keep = impact > 0
        self.docs, self.at, self.impact = docs, at[keep].astype(np.int64), impact[keep]
        self.key = term[keep].astype(np.int64) * len(docs) + self.at
        ends = np.flatnonzero(np.diff(term[keep], append=-1)) + 1
        longest = int(np.diff(ends, prepend=0).max(initial=1))
        # best[j][i]: place of the largest impact among postings i to i + 2**j - 1, the first of equals.
        # Runs that leave a posting list are never asked for.
        best = [np.arange(len(self.key), dtype=np.int32)]
        for j in range(longest.bit_length() - 1):
            left, right = best[-1], np.roll(best[-1], -(1 << j))
            best.append(np.where(self.impact[right] > self.impact[left], right, left))
        self.best = np.stack(best)

    def highest(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, place) of the largest posting of each range; 0 for an empty one."""
        size = last - first
        there = size > 0
        level = np.frexp(np.where(there, size, 1))[1] - 1
        a = self.best[level, np.where(there, first, 0)]
        b = self.best[level, np.where(there, last - (1 << level), 0)]
        place = np.where(self.impact[b] > self.impact[a], b, a)
        return np.where(there, self.impact[place], 0), place

    def search(self, terms: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of those given and the documents of this block."""
        n = len(self.docs)
        if not len(self.key):
            return scores, ids
        first, last = np.searchsorted(self.key, terms * n), np.searchsorted(self.key, (terms + 1) * n)
        full = last > first
        if not full.any():
            return scores, ids
        terms, first, last = terms[full] * n, first[None, full], last[None, full]
        low = np.zeros(1, np.int64)

        def bounds(first, last):
            most, place = self.highest(first, last)
            lead = most.argmax(axis=1)
            return most.sum(axis=1), self.at[place[np.arange(len(lead)), lead]]

        bound, split = bounds(first, last)
        while len(bound):
            if len(scores) == k:
                open_ = (bound > scores[-1]) | ((bound == scores[-1]) & (self.docs[low] < ids[-1]))
                if not open_.all():
                    low, first, last, bound, split = (x[open_] for x in (low, first, last, bound, split))
                    if not len(bound):
                        break
            if len(bound) > TAKEN:
                order = np.lexsort((low, -bound))
                taken, rest = order[:TAKEN], order[TAKEN:]
            else:
                taken, rest = slice(None), slice(0, 0)
            a, b, s, left = first[taken], last[taken], split[taken], low[taken]
            wanted = terms[None, :] + s[:, None]
            p = np.searchsorted(self.key, wanted)
            inside = p < b
            inside &= self.key[np.minimum(p, len(self.key) - 1)] == wanted
            exact = np.where(inside, self.impact[np.minimum(p, len(self.key) - 1)], 0).sum(axis=1)
            scores, ids = np.concatenate([scores, exact]), np.concatenate([ids, self.docs[s]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            # the intervals on both sides of the split
            a = np.concatenate([a, p + inside])
            b = np.concatenate([np.maximum(p, a[: len(s)]), b])
            both = np.concatenate([left, s + 1])
            go = (b > a).any(axis=1)
            a, b, both = a[go], b[go], both[go]
            if len(both):
                more, at = bounds(a, b)
                low, first, last = np.concatenate([low[rest], both]), np.concatenate([first[rest], a]), np.concatenate([last[rest], b])
                bound, split = np.concatenate([bound[rest], more]), np.concatenate([split[rest], at])
            else:
                low, first, last, bound, split = low[rest], first[rest], last[rest], bound[rest], split[rest]
        return scores, ids


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """Weight of each term by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, length: np.ndarray, n_docs: int, total: int, b: int = 50) -> np.ndarray:
    """Impact of each posting: weight times saturated occurrences, in whole numbers."""
    m = 100 - b + (b * length * n_docs) // max(1, total)
    return weight * ((1_000_000_000 * times) // np.maximum(1, 1000 * times + 20 * m))


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64)


def _ask(blocks: DataFrame, items: list[np.ndarray], vocabulary: np.ndarray, k: int) -> DataFrame:
    """item (place in the list), doc, score: the k best of each task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for lengths, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lengths = _numbers(lengths, "<i8")
                df += np.bincount(_numbers(term, "<i4"), minlength=len(df))
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *there.tolist()], pa.int64()), pa.array([n, total, *df[there].tolist()], pa.int64())],
                                         names=["term", "n"])

    # one row for each term of the items
    counts = {r[0]: r[1] for r in blocks.select("lengths", "term").mapInArrow(count, "term long, n long")
              .groupBy("term").agg(F.sum("n")).collect()}
    n_docs, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.array([counts.get(t, 0) for t in range(len(vocabulary))], np.int64)
    shared = blocks.sparkSession.sparkContext.broadcast(([np.searchsorted(vocabulary, x) for x in items], weights(n_docs, df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                ids = row["docs"].values.fill_null(_FIRST).to_numpy(zero_copy_only=False)
                lengths = _numbers(row["lengths"].as_py(), "<i8")
                term, at, times = (_numbers(row[c].as_py(), "<i4") for c in ("term", "at", "times"))
                lists = PostingLists(ids, term, at, impacts(weight[term], times, lengths[at], n_docs, total))
                for i, terms in enumerate(asked):
                    best[i] = lists.search(terms, *best[i], k)
        size = np.array([len(s) for s, _ in best], np.int64)
        if size.sum():
            ids = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), size), pa.int32()), pa.array(ids, mask=ids == _FIRST),
                 pa.array(np.concatenate([s for s, _ in best]))], names=["item", "doc", "score"])

    return blocks.mapInArrow(run, "item int, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item, rank, doc, score: the k best documents of each item, best first, ties by ascending id."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    size = asked.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-size[0] // ITEMS_AT_ONCE), -(-(size[1] or 0) // ITEM_BYTES))
    kind = asked.schema["item"].dataType
    out = None
    best = Window.partitionBy(f"{TMP}place").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    for p in range(passes):
        here = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).collect()
        terms, longest = terms_of([r["text"] for r in here])
        here, terms = [r["item"] for r, t in zip(here, terms) if len(t)], [t for t in terms if len(t)]
        vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        blocks = written(index(docs, vocabulary, longest, doc_col, text_col), "search-index")
        found = _ask(blocks, terms, vocabulary, k).withColumnRenamed("item", f"{TMP}place")
        names = spark.createDataFrame([(i, v) for i, v in enumerate(here)], f"{TMP}place int, item {kind.simpleString()}")
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        part = top.join(names, f"{TMP}place").select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")
        out = part if out is None else out.unionByName(part)
    return out
