"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Words are lower-cased runs of ``[0-9a-z]`` and characters beyond ASCII; a
shingle is five of them (all, where a text has fewer). A shingle weighs its
count times a mild inverse document frequency between 1 and 1 + ``idf_range``,
counted over every document in hashed buckets: a strong one would let the few
edited shingles of a near copy outweigh the many shared ones of a large group.

1. Texts with equal words are one node (128 hashed bits of the words).
2. Each node gets ``bands * rows`` consistent weighted samples, and as many samples of
   its distinct shingles, each of weight 1 (repeated passages change the weights of a
   copy but not its set); nodes that share a whole band of either kind meet in a bucket.
3. In each bucket the most central node (the one whose buckets are fullest)
   leads; all members are compared with it by weighted Jaccard similarity. So a
   group of n copies costs about n comparisons, not n squared.
4. Links so far form classes. In a bucket with several of them, members outside its
   largest class are compared with all its members, in rounds: the first round takes
   ``block`` of them as new leaders, each further one four times as many as the last.
   Between rounds classes are joined, and buckets of one class are done. So a round's
   rows grow with the bucket and with its leaders over ``block``; a large group that
   hangs together costs one round. Every pair is compared exactly, by products of
   shingle rows; one link joins two classes of a block and is given out.
5. Links form classes (label propagation in the shared folder).

A pair counts as near duplicates from ``threshold`` on, by weighted or by plain
Jaccard similarity.

Defined cases: null and empty texts are alone in their class; texts without
words are in one class with texts of the same characters; repeated rows are
copies of each other; null ids take part, and a class of null ids alone has a
null class id (``class_key`` tells classes apart); without documents the result
is empty.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.frames import written
from sigspark.llm.text import column_buffer, lower_ascii, mix64, returning_memory, slices, span_hashes, word_spans


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 5
    #: hashed document-frequency buckets, as a power of two
    df_bits: int = 20
    idf_range: float = 0.5
    #: members of a bucket that are held against each other in one go
    block: int = 1024
    #: bits of the filter that spares rows without candidates a shuffle, as a power of two
    filter_bits: int = 25
    seed: int = 20


_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWER_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _accumulated(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return p


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """(32-bit shingle hashes, row offsets, node names) of a text column; a row's shingles are sorted, repeats stay."""
    buf, off = column_buffer(column)
    low = lower_ascii(buf)
    starts, ends, rows = word_spans(low, off)
    n_rows = len(off) - 1
    words = span_hashes(low, starts, ends)
    count = np.bincount(rows, minlength=n_rows).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    total = len(words)
    prefix = np.zeros(total + 1, np.uint64)
    second = np.zeros(total + 1, np.uint64)
    power, inverse = _accumulated(_POWER, total + 1), _accumulated(_POWER_INVERSE, total + 1)
    np.cumsum(words * power[:total], out=prefix[1:], dtype=np.uint64)
    np.cumsum(mix64(words) * power[:total], out=second[1:], dtype=np.uint64)

    def spanned(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((p[b] - p[a]) * inverse[a] + (b - a).astype(np.uint64))

    per_row = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    row_of = np.repeat(np.arange(n_rows), per_row)
    begin = first[row_of] + np.arange(len(row_of)) - offsets[row_of]
    end = np.minimum(begin + size, first[row_of + 1])
    value = (spanned(prefix, begin, end) >> np.uint64(32)).astype(np.uint64)
    value = np.sort((row_of.astype(np.uint64) << np.uint64(32)) | value) & np.uint64(0xFFFFFFFF)
    one, two = spanned(prefix, first[:-1], first[1:]), spanned(second, first[:-1], first[1:])
    keys = np.stack([one, two], axis=1).astype(">u8").tobytes()
    names: list[bytes | None] = []
    for r in range(n_rows):
        if count[r]:
            names.append(keys[16 * r: 16 * r + 16])
        elif off[r] == off[r + 1]:
            names.append(None)
        else:                                              # characters without words: equal texts only
            names.append(hashlib.blake2b(buf[off[r]: off[r + 1]].tobytes(), digest_size=16).digest())
    return value.astype(np.uint32), offsets, names


def _distinct(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their counts, row offsets) of sorted rows."""
    n = len(flat)
    head = np.ones(n, bool)
    head[1:] = flat[1:] != flat[:-1]
    head[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(head)
    return flat[at], np.diff(np.append(at, n)), np.searchsorted(at, off)


def inverse_frequencies(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Weight of each hashed bucket; every task adds up its rows before the shuffle."""
    size, block = 1 << settings.df_bits, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, off, _ = shingles(batch.column(0), settings.shingle)
                found, _, _ = _distinct(flat, off)
                df += np.bincount(found & np.uint32(size - 1), minlength=size)
                n += int((np.diff(off) > 0).sum())
        zip_ = zstandard.ZstdCompressor(level=1)
        starts = list(range(0, size, block))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*starts, -1], pa.int32()),
             pa.array([zip_.compress(x.tobytes()) for x in (*(df[a: a + block] for a in starts), np.array([n], np.int64))], pa.binary())],
            names=["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(unzip.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    blocks = docs.select("text").mapInArrow(returning_memory(count), "block int, counts binary")
    found = {r[0]: np.frombuffer(r[1], "<i8") for r in blocks.groupBy("block").applyInPandas(add, "block int, counts binary").collect()}
    n = int(found.pop(-1)[0]) if found else 0
    df = np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(size, np.int64)
    rarity = np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 2)
    return (1.0 + settings.idf_range * np.clip(rarity, 0.0, 1.0)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: the same shingle and weight level win in similar texts.

    Sample i draws, for each shingle, r and c from Gamma(2, 1) and b from [0, 1):
    t = floor(ln w / r + b), and the shingle with the least ln c - r (t - b) - r wins; the
    sample is (shingle, t). The draws come from tables that the shingle's hash points into.
    """

    TABLE = 1 << 16

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.settings = settings
        self.n = settings.bands * settings.rows
        self.r = rng.gamma(2.0, 1.0, self.TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, self.TABLE)).astype(np.float32)
        self.b = rng.random(self.TABLE).astype(np.float32)
        self.factor = rng.integers(1, 1 << 63, self.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, found: np.ndarray, weight: np.ndarray, off: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
        """(rows, samples) 64-bit sample names; every row must have a shingle. Rows go in pieces that fit the cache."""
        rows = len(off) - 1
        out = np.empty((rows, self.n), np.uint64)
        a = 0
        while a < rows:
            b = min(rows, max(a + 1, int(np.searchsorted(off, off[a] + piece, side="right")) - 1))
            self._samples(found[off[a]: off[b]], weight[off[a]: off[b]], off[a: b + 1] - off[a], out[a: b])
            a = b
        return out

    def _samples(self, found: np.ndarray, weight: np.ndarray, off: np.ndarray, out: np.ndarray) -> None:
        rows = len(off) - 1
        log_w = np.log(weight).astype(np.float32)
        wide = mix64(found.astype(np.uint64))
        size = np.diff(off)
        for i in range(self.n):
            x = wide * self.factor[i]
            x ^= x >> np.uint64(31)
            places = x.astype("<u8", copy=False).view("<u2").reshape(-1, 4)     # 16 bits each, the lowest first
            r, b = self.r.take(places[:, 3]), self.b.take(places[:, 1])
            t = np.floor(log_w / r + b)
            score = self.log_c.take(places[:, 2]) - r * (t - b + np.float32(1.0))
            at = np.flatnonzero(score == np.repeat(np.minimum.reduceat(score, off[:-1]), size))
            if len(at) > rows:                                             # the smallest shingle among equals
                row = np.searchsorted(off, at, side="right")
                at = at[np.concatenate([[True], np.diff(row) > 0])]
            out[:, i] = mix64(wide[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def plain_samples(self, found: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(rows, samples) of the distinct shingles, all of weight 1; every row must have a shingle."""
        out = np.empty((len(off) - 1, self.n), np.uint64)
        wide = mix64(found.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for i in range(self.n):
            x = wide * self.factor[i]
            x ^= x >> np.uint64(31)
            out[:, i] = np.minimum.reduceat(x, off[:-1])
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """(rows, bands) bucket names."""
        s = self.settings
        name = np.zeros((len(samples), s.bands), np.uint64)
        grid = samples.reshape(len(samples), s.bands, s.rows)
        for j in range(s.rows):
            name = mix64(name * np.uint64(0x2545F4914F6CDD1D) + grid[:, :, j])
        return mix64(name + np.arange(s.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similarity(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(weighted, plain) Jaccard similarity of two sorted shingle arrays with repeats."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    mask = np.uint32(len(weights) - 1)
    wa, wb = weights[ua & mask].astype(np.float64) * ca, weights[ub & mask].astype(np.float64) * cb
    shared = float(np.minimum(wa[ia], wb[ib]).sum())
    union = len(ua) + len(ub) - len(both)
    whole = float(wa.sum() + wb.sum()) - shared
    return (shared / whole if whole else 0.0), (len(both) / union if union else 0.0)


def memberships(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc and node (16 bytes, null for null and empty text) of every row."""
    kind = docs.schema[doc_col].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, _, names = shingles(batch.column(1), settings.shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary())], names=["doc", "node"])

    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(returning_memory(name), f"doc {kind}, node binary")


def _first_copies(batches: Iterator[pa.RecordBatch], settings: Settings, piece: int = 1 << 20):
    """(names, distinct shingles, counts, offsets, repeated shingles, their offsets) of each slice, one row for each text of the task."""
    seen: set[bytes] = set()
    for whole in batches:
        for batch in slices(whole, "text", piece):
            flat, off, names = shingles(batch.column(0), settings.shingle)
            keep = []
            for r, name in enumerate(names):
                if off[r] < off[r + 1] and name not in seen:
                    seen.add(name)
                    keep.append(r)
            if not keep:
                continue
            size = np.diff(off)[keep]
            mask = np.zeros(len(off) - 1, bool)
            mask[keep] = True
            flat = flat[np.repeat(mask, np.diff(off))]
            yield [names[r] for r in keep], flat, np.concatenate([[0], np.cumsum(size)])


def candidate_buckets(docs: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """bucket, node and size of every bucket with two nodes or more."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)      # 2**df_bits entries

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(settings)
        mask = np.uint32(len(shared.value) - 1)
        for names, flat, off in _first_copies(batches, settings):
            found, count, off = _distinct(flat, off)
            weighted = sampler.bands(sampler.samples(found, shared.value[found & mask] * count, off))
            plain = mix64(sampler.bands(sampler.plain_samples(found, off)) + np.uint64(1))
            buckets = np.concatenate([weighted, plain], axis=1)
            node = pa.array(np.repeat(np.arange(len(names)), buckets.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets.ravel().view(np.int64)), pa.array(names, pa.binary()).take(node)], names=["bucket", "node"])

    bands = written(docs.select("text").mapInArrow(returning_memory(band), "bucket long, node binary").distinct(), "bands")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return bands.join(sizes, "bucket")


def _node_filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """A fixed-size bit array with a place set for each node; more nodes only make it less selective."""
    size = 1 << bits

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size, bool)
        for batch in batches:
            on[_filter_places(batch.column(0).to_pylist(), size)] = True
        packed = np.packbits(on)
        zip_, block = zstandard.ZstdCompressor(level=1), 1 << 16
        starts = range(0, len(packed), block)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()),
                                          pa.array([zip_.compress(packed[a: a + block].tobytes()) for a in starts], pa.binary())],
                                         names=["block", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        on = np.bitwise_or.reduce([np.frombuffer(unzip.decompress(x), np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [zstandard.ZstdCompressor(level=1).compress(on.tobytes())]})

    parts = nodes.select("node").mapInArrow(returning_memory(mark), "block int, bits binary").groupBy("block").applyInPandas(merge, "block int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for start, data in parts.collect():
        block = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        out[start: start + len(block)] = block
    return out


def _filter_places(names: list[bytes], size: int) -> np.ndarray:
    return (np.frombuffer(b"".join(names), ">u8")[0::2].astype(np.uint64) & np.uint64(size - 1)).astype(np.int64)


def _candidate_features(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """node and shingles (sorted, little-endian u32) of the nodes that share a bucket."""
    on = docs.sparkSession.sparkContext.broadcast(_node_filter(nodes, settings.filter_bits))
    size = 1 << settings.filter_bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, flat, off in _first_copies(batches, settings):
            at = _filter_places(names, size)
            keep = np.flatnonzero((on.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            raw = flat.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[r] for r in keep], pa.binary()),
                 pa.array([raw[4 * off[r]: 4 * off[r + 1]] for r in keep], pa.binary())], names=["node", "shingles"])

    found = docs.select("text").mapInArrow(returning_memory(features), "node binary, shingles binary")
    # copies from several tasks: one stays
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, features: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """a, b and linked of every pair (a, b)."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                # sizes alone rule out most unlike pairs; weights stay within the idf range
                if min(len(p), len(q)) * (1 + settings.idf_range) < settings.threshold * max(len(p), len(q)) and \
                        min(len(p), len(q)) < settings.threshold * len(np.unique(p if len(p) > len(q) else q)):
                    linked.append(False)
                    continue
                linked.append(max(similarity(p, q, table)) >= settings.threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left = features.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = features.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(returning_memory(compare), "a binary, b binary, linked boolean")


def _tokens(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((shingle, number of its repeat) as one integer, row offsets) of shingle rows: common tokens of two rows are
    common shingles with the smaller count."""
    raw = [x.as_buffer() for x in content]
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
    flat = np.frombuffer(b"".join(raw), "<u4")
    head = np.ones(len(flat), bool)
    head[1:] = flat[1:] != flat[:-1]
    head[off[:-1]] = True
    at = np.flatnonzero(head)
    repeat = np.arange(len(flat)) - at[np.cumsum(head) - 1]
    return (flat.astype(np.uint64) << np.uint64(32)) | repeat.astype(np.uint64), off


def _alike(settings: Settings, weights, piece: int = 1 << 20):
    """Links (and the classes they join) of asking members to members of their bucket in other classes, all compared exactly.

    Within a group one link joins two classes; members of one class need no further comparison.
    """
    least = settings.threshold - 1e-12

    def weighed(token: np.ndarray, off: np.ndarray):
        """(weight of each token, 1 for the first of a shingle, sums of both by row)."""
        w = weights.value[(token >> np.uint64(32)) & np.uint64(len(weights.value) - 1)].astype(np.float64)
        one = ((token & np.uint64(0xFFFFFFFF)) == 0).astype(np.int64)
        return w, one, np.add.reduceat(w, off[:-1]), np.add.reduceat(one, off[:-1])

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table.column("node").to_pylist()
        classes = table.column("label").to_pylist()
        labels = np.unique(np.array([x.hex() for x in classes]), return_inverse=True)[1]
        asks = table.column("asks").to_numpy()
        content = table.column("shingles").combine_chunks()
        length = np.array([len(x.as_buffer()) // 4 for x in content], np.int64)
        keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "mine", "other")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(names)).tolist()):
            ask = a + np.flatnonzero(asks[a:b])
            there = a + np.flatnonzero(~asks[a:b])
            if not len(ask) or not len(there):
                continue
            of = labels[a:b].copy()                                  # classes as the links of this group join them
            part = (np.cumsum(length[there]) - 1) // piece           # bounded numbers of tokens
            for rows in np.split(there, np.flatnonzero(np.diff(part)) + 1):
                if len(np.unique(of[np.append(rows, ask) - a])) == 1:
                    continue
                token, off = _tokens(content.take(pa.array(rows)))
                w, one, w_sum, one_sum = weighed(token, off)
                known, place = np.unique(token, return_inverse=True)
                for x in ask.tolist():
                    other = of[rows - a] != of[x - a]
                    if not other.any():
                        continue
                    mine, ends = _tokens(content.slice(x, 1))
                    _, _, w_mine, one_mine = weighed(mine, ends)
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    on = np.zeros(len(known), bool)
                    on[at[known[at] == mine]] = True
                    hit = on[place]
                    both, common = np.add.reduceat(w * hit, off[:-1]), np.add.reduceat(one * hit, off[:-1])
                    alike = np.maximum(both / (w_mine[0] + w_sum - both), common / (one_mine[0] + one_sum - common))
                    for y in rows[(alike >= least) & other].tolist():
                        if of[y - a] != of[x - a]:
                            out.append((x, y))
                            of[of == of[y - a]] = of[x - a]
        if out:
            rows = {tuple(sorted((names[x], names[y]))) + tuple(sorted((classes[x], classes[y]))) for x, y in out}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["a", "b", "label_a", "label_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group that goes on in the next batch waits for it."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in range(3)]
            key = [batch.column(c).to_numpy() for c in range(3)]
            open_ = (key[0] == last[0]) & (key[1] == last[1]) & (key[2] == last[2])
            cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            if cut:
                yield from pairs_of(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs_of(pa.Table.from_batches(held).combine_chunks())

    return run


def links(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """a and b of the verified links between nodes (``docs`` has the column text)."""
    weights = inverse_frequencies(docs, settings)
    buckets = candidate_buckets(docs, weights, settings)
    central = buckets.groupBy("node").agg((-F.sum("size")).alias("order"))
    members = written(buckets.join(central, "node").select("bucket", "size", F.struct("order", "node").alias("member")), "buckets")
    features = written(_candidate_features(docs, members.select("member.node").distinct(), settings), "shingles")
    leaders = members.groupBy("bucket").agg(F.min("member").alias("leader"))
    stars = members.join(leaders, "bucket").filter(F.col("member") != F.col("leader")).select(
        F.least("leader.node", "member.node").alias("a"), F.greatest("leader.node", "member.node").alias("b")).distinct()
    found = written(verified(stars, features, weights, settings).filter("linked").select("a", "b"), "pairs")
    led = members.join(leaders, "bucket").select("bucket", F.col("member.node").alias("node"), (F.col("member") == F.col("leader")).alias("led"))
    state = written(led.join(components(found), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"), "led"), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    most = settings.block
    while True:
        state = written(_asking(state, most), "asking")
        if not state.take(1):
            return found
        dealt = _placed(state.filter("asks"), settings.block, True).unionByName(_placed(state, settings.block, False))
        more = written(
            dealt.join(features, "node").select("bucket", "mine", "other", "node", "label", "shingles", "asks")
            .repartition("bucket", "mine", "other").sortWithinPartitions("bucket", "mine", "other")
            .mapInArrow(returning_memory(_alike(settings, shared)), "a binary, b binary, label_a binary, label_b binary").distinct(), "more-links")
        found = found.unionByName(more.select("a", "b"))
        joined = components(more.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(
            F.col("node").alias("label"), F.col("label").alias("after"))
        state = state.join(joined, "label", "left").select(
            "bucket", "node", F.coalesce("after", "label").alias("label"), (F.col("led") | F.col("asks")).alias("led"))
        most *= 4


def _asking(state: DataFrame, most: int) -> DataFrame:
    """Members (bucket, node, label, led) of the buckets where a pair of two classes is still to be compared, with asks (leads
    in this round: about ``most`` of a bucket at a time), and the bucket's numbers of members and of leaders.

    ``led`` members have been compared with their whole bucket. Of two members of different classes one is outside the
    largest class, so all pairs are done once everyone outside it has led.
    """
    parts = state.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("led"), 0).otherwise(1)).alias("open"))
    of = (parts.groupBy("bucket").agg(F.max(F.struct("n", "label", "open")).alias("main"), F.sum("n").alias("size"), F.sum("open").alias("all_open"))
          .select("bucket", F.col("main.label").alias("main"), "size", (F.col("all_open") - F.col("main.open")).alias("left"))
          .filter("left > 0"))
    share = F.ceil(F.col("left") / F.lit(most))
    turn = F.pmod(F.xxhash64(F.lit(most), "node"), share) == 0
    return state.join(of, "bucket").select(
        "bucket", "node", "label", "led", (~F.col("led") & (F.col("label") != F.col("main")) & turn).alias("asks"), "size",
        F.least("left", F.lit(most).cast("long")).alias("leaders"))


def _placed(rows: DataFrame, block: int, asks: bool) -> DataFrame:
    """Rows dealt to pairs of blocks: leaders to their own block and each block of members, members to their own and each block of leaders."""
    side, across = ("leaders", "size") if asks else ("size", "leaders")
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col(side) / F.lit(block))).cast("int")
    every = F.explode(F.sequence(F.lit(0), (F.ceil(F.col(across) / F.lit(block)) - 1).cast("int")))
    sides = [own.alias("mine"), every.alias("other")] if asks else [every.alias("mine"), own.alias("other")]
    return rows.select("bucket", *sides, "node", "label", F.lit(asks).alias("asks"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (its class's smallest node) of every node with an edge."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
                .select(F.col("a").alias("node"), "near"))
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("step"), "label")
        further = labels.select(F.col("node").alias("step"), F.col("label").alias("further"))
        after = written(stepped.join(further, "step", "left").select(
            "node", F.least("step", F.coalesce("further", "step")).alias("label"), (F.col("label") != F.least("step", F.coalesce("further", "step"))).alias("moved")),
            "labels")
        labels = after.select("node", "label")
        if not after.filter("moved").take(1):
            return labels


def node_classes(member: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """node, label, class_id, class_size and n_first of every node of ``member`` (doc, node)."""
    found = components(links(texts, settings))
    copies = member.filter(F.col("node").isNotNull()).groupBy("node", "doc").agg(F.count(F.lit(1)).alias("n"))
    named = written(copies.join(found, "node", "left").select("node", "doc", "n", F.coalesce("label", "node").alias("label")), "copies")
    sizes = written(named.groupBy("label").agg(F.min("doc").alias("class_id"), F.sum("n").alias("class_size")), "classes")
    firsts = (named.join(sizes, "label").filter(F.col("doc").eqNullSafe(F.col("class_id")))
              .groupBy("label").agg(F.sum("n").alias("n_first")))
    return named.select("node", "label").distinct().join(sizes.join(firsts, "label", "left"), "label")


def classes(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc, class_id (smallest id of the class), class_size and class_key of every row."""
    member = written(memberships(docs, doc_col, text_col, settings), "members")
    table = node_classes(member, docs.select(F.col(text_col).alias("text")), settings)
    grouped = member.join(table, "node").select("doc", "class_id", "class_size", F.hex("label").alias("class_key"))
    alone = member.filter(F.col("node").isNull()).select(
        "doc", F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("string").alias("class_key"))
    return grouped.unionByName(alone)


def keep_first(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of each class, with all its columns: the smallest id, any one of equal rows with that id."""
    member = written(memberships(docs, doc_col, text_col, settings), "members")
    table = written(node_classes(member, docs.select(F.col(text_col).alias("text")), settings), "node-classes")
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    base = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in place.items()])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, _, names = shingles(batch.column(0), settings.shingle)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.binary())], names=[*batch.schema.names[1:], "node"])

    marked = base.mapInArrow(returning_memory(name), base.drop("text").schema.add("node", "binary"))
    firsts = (marked.join(table, "node", "left")
              .filter(F.col("node").isNull() | F.col(place[doc_col]).eqNullSafe(F.col("class_id"))))
    once = firsts.filter(F.col("node").isNull() | (F.col("n_first") == 1))
    repeated = firsts.filter(F.col("n_first") > 1)
    if table.filter("n_first > 1").take(1):
        once = once.unionByName(repeated.dropDuplicates(["label"]))
    return once.select(*[F.col(n).alias(c) for c, n in place.items()])
