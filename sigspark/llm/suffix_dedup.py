"""Removal of long byte strings that occur more than once, by column-wise sorting of contexts.

Every ``length``-byte window of a text belongs to one anchor: the smallest hash
among its short grams (the last of equals). Equal windows have equal anchors
at the same place inside them, so only contexts around anchors of equal hash
can hold equal windows, and their columns line up at the anchor. An anchor's
context runs from its first window's start to its last window's end.

Contexts that meet are sorted as a collection, column by column from the right:
each round inserts one symbol of every context, moves it by a stable partition
(the collection's positional Burrows-Wheeler transform) and updates the common
prefixes of neighbours. Windows with a common prefix of ``length`` or more
occur elsewhere. A round reads its column from, and appends its findings to,
sequential files, so memory holds one order, one prefix array and one column.

Spark's part: anchors are found row by row; hashes that occur once are
dropped by a semi join; equal contexts are pre-aggregated (two copies of each
say all), and contexts are dealt out by anchor hash. Copies of a text beyond
the second in one task send no anchors. Anchors with more than ``hot_contexts``
different contexts are split: their windows are compared through 64-bit hashes
in a second aggregation instead of meeting in one task.

Defined cases: null text counts as empty; texts shorter than ``length`` lose
nothing; runs of one symbol, overlapping places and repeated rows count as
occurrences of each other; ids play no part.
"""
from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.frames import written
from sigspark.llm.text import _BYTE_CODE, _inverse_powers, _powers, column_buffer, mix64, slices

#: Bytes of the grams that anchors are chosen from.
GRAM = 16
#: Different contexts of one anchor hash that are sorted together.
HOT_CONTEXTS = 20_000
#: Contexts sorted in one go inside a task (whole anchor groups).
SORT_CONTEXTS = 40_000
#: Text bytes whose windows are handled at once.
STRETCH = 1 << 20


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor place, first window, last window) of one text; every window has one anchor."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    width = length - gram + 1                              # grams in a window
    found = []
    for begin in range(0, n - length + 1, STRETCH):
        stop = min(begin + STRETCH, n - length + 1)        # window starts [begin, stop)
        part = data[begin: stop - 1 + length]
        m = len(part)
        prefix = np.zeros(m + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * _powers(m), out=prefix[1:], dtype=np.uint64)
        value = mix64((prefix[gram:] - prefix[:-gram]) * _inverse_powers(m)[: m - gram + 1])
        grams = len(value)
        # order by hash, the last place first among equals; places in a stretch stay below 2**21
        place = np.arange(grams, dtype=np.uint64)
        key = (value & ~np.uint64((1 << 21) - 1)) | (np.uint64((1 << 21) - 1) - place)
        blocks = -(-grams // width)
        padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:grams] = key
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = stop - begin
        least = np.minimum(behind[:windows], ahead[width - 1: width - 1 + windows])
        at = (np.uint64((1 << 21) - 1) - (least & np.uint64((1 << 21) - 1))).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        tails = np.append(heads[1:], windows) - 1
        found.append((value[at[heads]], at[heads] + begin, heads + begin, tails + begin))
    return tuple(np.concatenate(c) for c in zip(*found))


def _identity(text: Column) -> tuple[Column, Column]:
    """79 hashed bits that name a text; copies share their name and so their findings."""
    return F.xxhash64(text), F.xxhash64(text, F.lit("tag")).bitwiseAND(F.lit(0x7FFF)).cast("int")


def _prepared(docs: DataFrame, text_col: str, carry: list[str] | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    name, tag = _identity(text)
    return docs.select(name.alias("name"), tag.alias("tag"), text.alias("text"),
                       *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry or [])])


def _pack(tag: np.ndarray | int, first: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One long: text tag, first window, windows' reach before and after the anchor."""
    return (np.int64(tag) << 48) | (first << 16) | (before << 8) | after


def find_anchors(prepared: DataFrame, length: int) -> DataFrame:
    """anchor, context (hash of the context's bytes), name, at (packed place) of every anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, off = column_buffer(batch.column(2))
                names, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                out = []
                for r in range(batch.num_rows):
                    data = buf[off[r]: off[r + 1]]
                    if len(data) < length:
                        continue
                    key = hashlib.blake2b(data.tobytes(), digest_size=16).digest()
                    copies = seen.get(key, 0)
                    if copies >= 2:
                        continue
                    seen[key] = copies + 1
                    value, at, lo, hi = anchors(data, length)
                    prefix = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(_BYTE_CODE[data] * _powers(len(data)), out=prefix[1:], dtype=np.uint64)
                    context = mix64((prefix[hi + length] - prefix[lo]) * _inverse_powers(len(data))[lo])
                    # place: first window (32 bits), then anchor - first and last - first
                    packed = _pack(int(tags[r]), lo, at - lo, hi - lo)
                    out.append((value.view(np.int64), context.view(np.int64), np.full(len(at), names[r], np.int64), packed))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                     names=["anchor", "context", "name", "at"])

    return prepared.select("name", "tag", "text").mapInArrow(run, "anchor long, context long, name long, at long")


class ColumnSort:
    """Sorts contexts column by column from the right and marks windows with an equal neighbour."""

    def __init__(self, group: np.ndarray, before: np.ndarray, windows: np.ndarray, contents: list[bytes], length: int):
        """Contexts in group order; ``before``: anchor - first window; ``windows``: how many windows."""
        self.group, self.length, self.n = group, length, len(group)
        self.low = -before                                  # columns count from the anchor
        self.end = self.low + windows - 1 + length
        self.left = int(self.low.min())
        self.right = int(self.end.max())
        self.columns = tempfile.TemporaryFile(prefix="columns-")
        grid = np.zeros((self.n, self.right - self.left), np.uint8)
        for i, data in enumerate(contents):
            a = int(self.low[i]) - self.left
            grid[i, a: a + len(data)] = np.frombuffer(data, np.uint8)
        for c in range(grid.shape[1] - 1, -1, -1):          # the rounds' order
            self.columns.write(np.ascontiguousarray(grid[:, c]).tobytes())
        self.columns.seek(0)

    def run(self) -> np.ndarray:
        """(contexts, columns) marks: True where the window that starts at the column occurs elsewhere."""
        n, group = self.n, self.group
        findings = tempfile.TemporaryFile(prefix="prefixes-")
        starting = {int(c): np.flatnonzero(self.end == c) for c in np.unique(self.end)}
        order = np.zeros(0, np.int64)                        # contexts whose suffix from this column on is sorted
        match = np.zeros(0, np.int64)                        # column where the common prefix with the one above ends
        for column in range(self.right - 1, self.left - 1, -1):
            symbols = np.frombuffer(self.columns.read(n), np.uint8)
            fresh = starting.get(column + 1)
            if fresh is not None:                            # their suffix is still empty: first in their group
                rank = np.concatenate([group[fresh] * 2, group[order] * 2 + 1])
                both = np.concatenate([fresh, order])
                ends = np.concatenate([np.full(len(fresh), column + 1), match])
                by = np.argsort(rank, kind="stable")
                # the first old context of a group now follows an empty suffix
                order, ends = both[by], ends[by]
                is_old = by >= len(fresh)
                after_fresh = np.zeros(len(by), bool)
                after_fresh[1:] = is_old[1:] & ~is_old[:-1]
                ends[after_fresh] = column + 1
                match = ends
            live = self.low[order] <= column
            if not live.all():                               # contexts that have begun: drop them from the order
                match = self._keep(match, live)
                order = order[live]
            key = group[order] * 256 + symbols[order]
            if len(key) > 1 and (key[1:] < key[:-1]).any():
                by = np.argsort(key, kind="stable")
                match = self._moved(match, by)
                order, key = order[by], key[by]
            if len(key):
                match = match.copy()
                match[0] = column
                match[1:][key[1:] != key[:-1]] = column
            marks = np.zeros(n, bool)
            far = match >= column + self.length
            marks[order[far]] = True
            marks[order[:-1][far[1:]]] = True
            findings.write(np.packbits(marks).tobytes())
        findings.seek(0)
        rounds = self.right - self.left
        rows = np.frombuffer(findings.read(), np.uint8).reshape(rounds, -1)
        return np.unpackbits(rows, axis=1, count=n)[::-1].T.astype(bool)

    @staticmethod
    def _keep(match: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Common prefix ends after rows are taken out: the least of the rows between."""
        at = np.flatnonzero(live)
        if not len(at):
            return match[:0]
        return np.minimum.reduceat(match[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))

    @staticmethod
    def _moved(match: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Ends for the new order: the least over the old rows between two that are now neighbours.

        Only pairs of one group and symbol matter, and those keep their old order.
        """
        out = match[by]
        prev, cur = by[:-1], by[1:]
        apart = np.flatnonzero(cur > prev + 1) + 1
        if len(apart):
            bounds = np.empty(2 * len(apart), np.int64)
            bounds[0::2] = by[apart - 1] + 1
            bounds[1::2] = by[apart] + 1
            padded = np.append(match, np.iinfo(np.int64).max)
            out[apart] = np.minimum.reduceat(padded, bounds)[0::2]
        return out


def _runs(marks: np.ndarray, length: int) -> list[int]:
    """Covered byte ranges [a, b) of marked window starts, flat and merged."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > length)          # ranges that touch are one
    first = np.concatenate([[0], breaks + 1])
    last = np.append(breaks, len(at) - 1)
    return np.stack([at[first], at[last] + length], axis=1).ravel().tolist()


_SHAPE = ("anchor", "context", "shape")                       # shape: reach before the anchor and number of windows


def _sort_groups(length: int):
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("shape", pa.int32()), ("runs", pa.list_(pa.int32()))])

    def solve(rows: pd.DataFrame) -> pa.RecordBatch:
        rows = rows.sort_values("anchor", kind="stable")
        anchor = rows["anchor"].to_numpy()
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]])) if len(anchor) else anchor
        copies = np.minimum(rows["n"].to_numpy(), 2)
        row = np.repeat(np.arange(len(rows)), copies)          # equal contexts: two copies say all
        shape = rows["shape"].to_numpy()
        contents = rows["content"].to_list()
        sort = ColumnSort(group[row], (shape >> 8)[row].astype(np.int64), ((shape & 255) + 1)[row].astype(np.int64),
                          [contents[i] for i in row.tolist()], length)
        marks = sort.run()
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        runs = []
        for i, r in enumerate(first.tolist()):
            a = int(sort.low[r]) - sort.left
            runs.append(_runs(marks[r, a: a + int(shape[i] & 255) + 1], length))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(rows["context"].to_numpy()), pa.array(shape.astype(np.int32)), pa.array(runs, pa.list_(pa.int32()))],
            schema=schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; whole groups are sorted together in turns of bounded size."""
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            last = pdf["anchor"].iloc[-1]
            same = pdf["anchor"] == last
            if n + len(pdf) >= SORT_CONTEXTS and (held or not same.all()):
                done = pd.concat([*held, pdf[~same]])
                cut = done["anchor"] == last                  # the open group waits for its other rows
                whole = done[~cut]
                if len(whole):
                    yield solve(whole.drop_duplicates(list(_SHAPE)))
                held = [x for x in (done[cut], pdf[same]) if len(x)]
            else:
                held.append(pdf)
            n = sum(map(len, held))
        if held:
            yield solve(pd.concat(held).drop_duplicates(list(_SHAPE)))

    return run


def repeated_runs(docs: DataFrame, length: int = 200, text_col: str = "text",
                  hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """name, tag and runs (flat byte ranges, may overlap) of every text with a repeated window.

    name and tag are hashes of the text; ids are not needed.
    """
    if not GRAM < length <= 255 + GRAM - 1:
        raise ValueError("the window must be longer than a gram and below 271 bytes")
    prepared = _prepared(docs, text_col)
    found = find_anchors(prepared, length)                  # read twice: finding them again is cheaper than storing all
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    cand = written(found.join(twice, "anchor", "left_semi")
                   .withColumn("shape", F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int"))
                   .withColumn("first", F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFFFFFF)))
                   .withColumn("tag", F.shiftrightunsigned("at", 48).cast("int")).drop("at"), "anchors")
    distinct = written(cand.groupBy(*_SHAPE).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "tag", "first")).alias("one"))
                       .select(*_SHAPE, "n", "one.*"), "contexts")
    hot = written(distinct.groupBy("anchor").count().filter(F.col("count") > hot_contexts).select("anchor"), "hot-anchors")
    # contents come from one row each
    wanted = distinct.groupBy("name", "tag").agg(F.collect_list(F.struct(*_SHAPE, "n", "first")).alias("wanted"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One copy of each text of the task."""
        zip_ = zstandard.ZstdCompressor(level=1)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            batch = batch.take(pa.array(keep, pa.int64()))
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zip_.compress(x) for x in raw], pa.binary())],
                                             names=["name", "tag", "packed"])

    texts = prepared.filter(F.octet_length("text") >= length).mapInArrow(squeeze, "name long, tag int, packed binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                data = unzip.decompress(batch.column(0)[r].as_py())
                rows = batch.column(1)[r].values
                first, shape = rows.field("first").to_numpy(), rows.field("shape").to_numpy()
                size = (shape & 255) + length
                content = pa.array([data[a: a + b] for a, b in zip(first.tolist(), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.field(c) for c in (*_SHAPE, "n")] + [content],
                                                 names=[*_SHAPE, "n", "content"])

    contents = texts.join(wanted, ["name", "tag"]).select("packed", "wanted").mapInArrow(
        cut, "anchor long, context long, shape int, n long, content binary")
    calm = contents
    resolved = None
    if hot.take(1):
        contents = written(contents, "contents")
        calm = contents.join(hot, "anchor", "left_anti")
        resolved = _hot_runs(contents.join(hot, "anchor", "left_semi"), length)
    solved = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _sort_groups(length), "anchor long, context long, shape int, runs array<int>")
    if resolved is not None:
        solved = solved.unionByName(resolved)
    hit = cand.join(solved.filter(F.size("runs") > 0), list(_SHAPE)).select("name", "tag", "first", "runs")
    return (hit.groupBy("name", "tag").agg(F.collect_set(F.struct("first", "runs")).alias("found"))
            .select("name", "tag", F.flatten(F.transform("found", lambda x: F.transform(x["runs"], lambda v: v.cast("long") + x["first"]))).alias("runs")))


def _hot_runs(contents: DataFrame, length: int) -> DataFrame:
    """Runs of contexts whose anchor is too common to meet in one task: window hashes, pre-aggregated."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                anchor, context, shape, n, content = (batch.column(i)[r].as_py() for i in range(5))
                data = np.frombuffer(content, np.uint8)
                prefix = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_BYTE_CODE[data] * _powers(len(data)), out=prefix[1:], dtype=np.uint64)
                k = len(data) - length + 1
                value = mix64((prefix[length:] - prefix[:-length]) * _inverse_powers(len(data))[:k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, anchor)), pa.array(np.full(k, context)), pa.array(np.full(k, shape, np.int32)),
                     pa.array(np.full(k, n)), pa.array(np.arange(k, dtype=np.int32)), pa.array(value.view(np.int64))],
                    names=[*_SHAPE, "n", "place", "window"])

    rows = contents.dropDuplicates(list(_SHAPE)).mapInArrow(
        windows, "anchor long, context long, shape int, n long, place int, window long")
    twice = rows.groupBy("anchor", "window").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("anchor", "window")
    kept = rows.join(twice, ["anchor", "window"], "left_semi").groupBy(*_SHAPE).agg(F.sort_array(F.collect_set("place")).alias("places"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(3).to_pylist():
                marks = np.zeros(256, bool)
                marks[places] = True
                out.append(_runs(marks, length))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=[*_SHAPE, "runs"])

    return kept.mapInArrow(runs, "anchor long, context long, shape int, runs array<int>")


def remove(docs: DataFrame, length: int = 200, text_col: str = "text",
           whole_characters: bool = False, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """All columns of ``docs`` (text_col left out) with n_bytes, spans (removed byte ranges) and kept (binary).

    ``whole_characters``: characters that are cut in two are dropped from ``kept``.
    """
    runs = repeated_runs(docs, length, text_col, hot_contexts)
    others = [c for c in docs.columns if c != text_col]
    prepared = _prepared(docs, text_col, others)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([zip_.compress(x) for x in raw], pa.binary()), *batch.columns[3:]],
                names=["name", "tag", "packed", *batch.schema.names[3:]])

    schema = prepared.drop("name", "tag", "text").schema
    squeezed_schema = ", ".join(["name long", "tag int", "packed binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema]])
    squeezed = prepared.mapInArrow(squeeze, squeezed_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, spans, kept = [], [], []
            for packed, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = unzip.decompress(packed) if packed else b""
                merged = merge(found or [])
                out, at = [], 0
                for a, b in merged:
                    out.append(data[at:a])
                    at = b
                out.append(data[at:])
                left = b"".join(out)
                if whole_characters and merged:
                    left = b"".join(x.decode("utf-8", "ignore").encode("utf-8") for x in out)
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[*batch.schema.names[2:], "n_bytes", "spans", "kept"])

    joined = squeezed.join(runs, ["name", "tag"], "left").select("packed", "runs", *[f.name for f in schema])
    out_schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema],
                            "n_bytes long", "spans array<struct<start:bigint,end:bigint>>", "kept binary"])
    done = joined.mapInArrow(cut, out_schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "n_bytes", "spans", "kept")


def merge(flat: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of flat byte ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[0::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
