"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is the
histogram of lengths: at most ``capacity`` rows, however many documents there
are. The histogram is solved once (``solve``): around the largest remaining
length the undominated fillings are enumerated, branches are pruned by the
waste that still allows fewer sequences than the incumbent, and best-fit
decreasing gives the first incumbent. A filling is used as often as the counts
allow, so the solver works on a few thousand patterns at any corpus size.
Spark then numbers the pieces within each length and every piece finds its
sequence and offset from its number alone.
"""
from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.frames import TMP, written
from sigspark.llm.text import slices
from sigspark.llm.tokenization import worker_encoder

#: Fillings tried for one largest length before the best found so far is taken.
FILLINGS = 400
#: Branches of the search tree that are opened after the first descent.
BRANCHES = 60

Pattern = tuple[tuple[tuple[int, int], ...], int]     # ((length, count), ...) decreasing, and how often


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram; bins that look alike are handled together."""
    open_bins: dict[int, Counter] = {}                 # room -> patterns -> bins
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            bisect.insort(rooms, room)
        open_bins[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                n = left // each
                put(capacity - each * length, ((length, each),), n)
                left -= n * each
                continue
            room = rooms[at]
            pattern, n = next(iter(open_bins[room].items()))
            each = min(room // length, left)
            n = min(n, left // each)
            open_bins[room][pattern] -= n
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            put(room - each * length, (*pattern, (length, each)), n)
            left -= n * each
    return [(p, n) for bins in open_bins.values() for p, n in bins.items()]


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int) -> list[tuple[tuple[int, int], ...]]:
    """Undominated fillings of ``room`` that waste at most ``waste``, fullest first.

    ``lengths`` is increasing. A filling is dominated if another one puts a
    larger length in the place of some of its own; trying lengths from the
    largest down and stopping at a full one leaves those out.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    best = max(0, room - waste)
    steps = 0

    def grow(top: int, room_left: int, chosen: tuple[tuple[int, int], ...]) -> bool:
        nonlocal best, steps
        steps += 1
        at = bisect.bisect_right(lengths, room_left, 0, top) - 1
        while at >= 0 and not counts[lengths[at]]:
            at -= 1
        if at < 0:                                     # maximal: nothing more fits
            if room - room_left >= best:
                best = room - room_left
                found.append((room_left, chosen))
            return room_left == 0
        while at >= 0 and steps < FILLINGS:
            length = lengths[at]
            n = min(counts[length], room_left // length)
            if n:
                for k in range(n, 0, -1):
                    if grow(at, room_left - k * length, (*chosen, (length, k))):
                        return True
                    if steps >= FILLINGS:
                        break
                if room - room_left + _reach(lengths, counts, at, room_left) < best:
                    break
            at -= 1
        return False

    grow(len(lengths), room, ())
    if not found:                                      # nothing within the allowed waste: the largest that fit
        left, chosen = room, []
        for length in reversed(lengths):
            k = min(counts[length], left // length)
            if k:
                chosen.append((length, k))
                left -= k * length
        found.append((left, tuple(chosen)))
    found.sort(key=lambda x: (x[0], [(-a, -k) for a, k in x[1]]))
    return [p for _, p in dict.fromkeys(found)]


def _reach(lengths: list[int], counts: dict[int, int], top: int, room: int) -> int:
    """Upper bound of what the lengths below ``top`` can fill of ``room``."""
    total = 0
    for at in range(top - 1, -1, -1):
        total += lengths[at] * counts[lengths[at]]
        if total >= room:
            return room
    return total


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that pack the histogram, in as few bins as the search finds.

    An empty histogram gives no pattern. Counts must be positive, lengths
    between 1 and ``capacity``.
    """
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(a * n for a, n in counts.items())
    bound = -(-total // capacity)
    incumbent = best_fit(counts, capacity)
    incumbent_bins = sum(n for _, n in incumbent)
    # depth-first with the fullest filling first; the alternatives of the last steps are opened on return
    stack = [(dict(counts), sorted(counts), [], 0, total, None)]
    opened = 0
    while stack and incumbent_bins > bound and opened <= BRANCHES:
        left, lengths, patterns, bins, rest, forced = stack.pop()
        opened += 1
        while rest:
            if bins + -(-rest // capacity) >= incumbent_bins:
                break                                   # waste bound: cannot beat the incumbent
            top = lengths[-1]
            left[top] -= 1
            if forced is None:
                slack = (incumbent_bins - 1 - bins) * capacity - rest
                options = fillings(lengths, left, capacity - top, slack)
                if len(options) > 1 and len(stack) < BRANCHES:
                    saved = dict(left)
                    saved[top] += 1
                    stack.extend((dict(saved), list(lengths), list(patterns), bins, rest, o) for o in options[2:0:-1])
                chosen = options[0]
            else:
                chosen, forced = forced, None
            left[top] += 1
            whole = Counter(dict(chosen))
            whole[top] += 1
            times = min(left[a] // k for a, k in whole.items())
            for a, k in whole.items():
                left[a] -= times * k
                if not left[a]:
                    lengths.pop(bisect.bisect_left(lengths, a))
                    del left[a]
            used = sum(a * k for a, k in whole.items())
            patterns.append((tuple(sorted(whole.items(), reverse=True)), times))
            bins += times
            rest -= used * times
        if not rest and bins < incumbent_bins:
            incumbent, incumbent_bins = patterns, bins
    return incumbent


def placements(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first number, first sequence, copies in a sequence and offset of the first copy, by pattern."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    first = 0
    for pattern, times in patterns:
        offset = 0
        for length, k in pattern:
            out.setdefault(length, []).append((seen[length], first, k, offset))
            seen[length] += times * k
            offset += k * length
        first += times
    return {a: tuple(np.array(c, np.int64) for c in zip(*rows)) for a, rows in out.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
           doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, piece, start, length, ids_crc32 of every document's token ids and the end id.

    Documents longer than ``capacity`` are cut from the end into full pieces,
    so only piece 0 may be shorter. Null or empty text is the end id alone.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                flat, off = encoder.encode_column(batch.column(1))
                rows = batch.num_rows
                ids = np.full(len(flat) + rows, end_id, np.uint32)
                keep = np.ones(len(ids), bool)
                ends = off[1:] + np.arange(rows)
                keep[ends] = False
                ids[keep] = flat
                begin = np.concatenate([[0], ends[:-1] + 1])
                size = ends + 1 - begin
                n = -(-size // capacity)
                row = np.repeat(np.arange(rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = size - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (begin[row] + start) * 4
                crc = [zlib.crc32(raw[a: b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = 2048, length_col: str = "length", order_by: tuple[str, ...] = (),
         rows_per_bucket: int = 20_000) -> DataFrame:
    """``items`` with sequence_id and offset, packed into sequences of at most ``capacity``.

    ``items`` must be stable when read twice (a written table). Items of one
    length are interchangeable: they are numbered in hash buckets, so a length
    that a third of all rows share is spread over many tasks. Rows whose
    length fills a sequence alone are handled like all others. Empty input
    gives an empty result; a length outside 1..capacity raises.
    """
    spark = items.sparkSession
    length = F.col(length_col)
    counts = {int(r[0]): int(r[1]) for r in items.groupBy(length.alias("n")).count().collect()}   # <= capacity rows
    table = placements(solve(counts, capacity))
    shared = spark.sparkContext.broadcast(table)       # bounded by lengths x patterns, not by rows
    buckets = max(1, -(-sum(counts.values()) // rows_per_bucket))
    columns = list(order_by) or [c for c in items.columns if c != length_col]
    marked = items.withColumn(TMP + "bucket", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(buckets)).cast("int"))
    sizes = marked.groupBy(length.alias(TMP + "n"), F.col(TMP + "bucket").alias(TMP + "b")).count()
    before = Window.partitionBy(TMP + "n").orderBy(TMP + "b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(TMP + "n", TMP + "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias(TMP + "first"))
    number = F.row_number().over(Window.partitionBy(length, TMP + "bucket").orderBy(*columns)) - 1
    numbered = (marked.withColumn(TMP + "i", number)
                .join(firsts, (length == F.col(TMP + "n")) & (F.col(TMP + "bucket") == F.col(TMP + "b")))
                .withColumn(TMP + "number", F.col(TMP + "i") + F.col(TMP + "first")))
    kept = [F.col(c) for c in items.columns]
    schema = items.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = shared.value
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if not len(part):
                    continue
                n = int(size[part[0]])
                first, base, each, at = rows_of[n]
                p = np.searchsorted(first, number[part], side="right") - 1
                i = number[part] - first[p]
                sequence[part] = base[p] + i // each[p]
                offset[part] = at[p] + (i % each[p]) * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.select(*kept, F.col(TMP + "number").cast("long").alias(TMP + "number")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
                   doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences: doc, piece, start, length, ids_crc32, sequence_id, offset.

    Null doc ids and repeated rows are pieces like any other; extra columns are ignored.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id, doc_col, text_col), "pieces")
    return pack(cut, capacity, order_by=("doc", "piece", "start", "ids_crc32"))
