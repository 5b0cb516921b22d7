"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, everything but letters becomes one blank, and
n-grams of 1 to ``max_n`` characters are hashed to ``buckets`` features. A
feature's value is its share of the text's n-grams times its inverse document
frequency, which is counted over every training document. The weights are
trained by follow-the-regularised-leader (proximal) with L1 and L2 penalties
on a bounded, hash-chosen sample of labelled documents (``sample_docs``): each
epoch runs on the sample's partitions in parallel and their states are averaged
by Spark. A temperature is then fitted on sample documents that training left
out, so that scores are calibrated probabilities.

N-grams are made in pieces of bounded bytes; a text longer than a piece goes on
over several, so one very long text needs no more memory than many short ones.

Defined cases: null text or text without letters gives ``und`` with score 0;
nothing to learn from gives ``und`` everywhere; ties between classes go to the
first in sorted order; repeated rows come out once each; null ids are neither
held out nor learned from; language, source and id are never inputs of a
prediction.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.frames import written
from sigspark.llm.text import column_buffer, mix64, returning_memory, slices

UNDETERMINED = "und"

#: Bytes of text whose n-grams are held at once.
PIECE_BYTES = 256 << 10

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """True for code points that are letters; built once per process."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTERS


@dataclass(frozen=True)
class Settings:
    """Features and training; ``sample_docs`` bounds the labelled documents that weights are fitted on."""
    buckets: int = 1 << 16
    max_n: int = 3
    sample_docs: int = 6000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 8.0
    parts: int = 6


@dataclass(frozen=True)
class Model:
    """weights: (buckets, classes) with the inverse document frequencies multiplied in."""
    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings


@dataclass(frozen=True)
class Piece:
    """Hashed n-grams of consecutive rows of a batch, in row order; a long row goes on over several pieces."""
    first: int                  # the first row's place in the batch
    flat: np.ndarray
    off: np.ndarray             # row offsets into flat
    letters: np.ndarray         # letters in each row
    goes_on: bool               # the first row began in an earlier piece
    unfinished: bool            # the last row ends in a later piece


def _cuts(buf: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row behind the last, first byte, byte behind the last) of pieces of about ``limit`` bytes.

    Cuts lie between rows; rows above the limit are cut between characters.
    """
    row, rows = 0, len(off) - 1
    while row < rows:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        if end > row:
            yield row, end, int(off[row]), int(off[end])
            row = end
            continue
        at, stop = int(off[row]), int(off[row + 1])
        while at < stop:
            to = min(stop, at + limit)
            while to < stop and buf[to] & 0xC0 == 0x80:          # inside a character
                to += 1
            yield row, row + 1, at, to
            at = to
        row += 1


def _grams(column: pa.Array, settings: Settings, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The n-grams of a text column, piece by piece: memory follows ``limit``, not the batch or its longest text."""
    buf, off = column_buffer(column)
    tail, in_word = np.zeros(0, np.uint32), False                # of the text so far, where a piece goes on with it
    for first, end, a, b in _cuts(buf, off, limit):
        goes_on, unfinished = a > off[first], b < off[end]
        inner = np.clip(off[first: end + 1], a, b) - a
        texts = pa.LargeStringArray.from_buffers(end - first, pa.py_buffer(inner.astype(np.int64)), pa.py_buffer(buf[a:b].tobytes()))
        lower = pc.utf8_lower(texts)
        sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.frombuffer(column_buffer(lower)[0].tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(end - first, dtype=np.int32), sizes)
        letter = _letters()[code]
        letters = np.bincount(row[letter], minlength=end - first)
        keep = letter.copy()
        # the first other character behind a letter of the same row stays as a blank
        keep[1:] |= ~letter[1:] & letter[:-1] & (row[1:] == row[:-1])
        if goes_on and len(keep):
            keep[0] |= in_word
        if not goes_on:
            tail = tail[:0]
        in_word = bool(letter[-1]) if len(letter) else in_word
        old = len(tail)
        code = np.concatenate([tail, np.where(letter, code, np.uint32(32))[keep]])
        row = np.concatenate([np.zeros(old, np.int32), row[keep]])
        tail = code[max(0, len(code) - settings.max_n + 1):] if unfinished else tail[:0]
        value, found = np.zeros(len(code), np.uint64), []
        for n in range(1, settings.max_n + 1):
            if len(code) < n:
                break
            value = value[: len(code) - n + 1] * np.uint64(0x110001) + code[n - 1:] + np.uint64(1)
            # inside one row, and not among the n-grams of the piece before
            take = row[: len(code) - n + 1] == row[n - 1:]
            take[: max(0, old - n + 1)] = False
            hashed = mix64(value[take] * np.uint64(8) + np.uint64(n)) % np.uint64(settings.buckets)
            found.append((hashed.astype(np.int32), row[: len(take)][take]))
        counts = [np.bincount(r, minlength=end - first) for _, r in found]
        total = sum(counts) if counts else np.zeros(end - first, np.int64)
        start = np.concatenate([[0], np.cumsum(total)])
        flat, place = np.empty(int(start[-1]), np.int32), start[:-1].copy()
        for (hashed, r), n in zip(found, counts):                # each row's n-grams of one length behind the shorter ones
            flat[np.arange(len(r)) + (place - (np.cumsum(n) - n))[r]] = hashed
            place += n
        yield Piece(first, flat, start, letters, goes_on, unfinished)


def document_frequencies(docs: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """(documents, documents holding each feature); every task adds up its rows before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(settings.buckets, np.int64)
        mark = np.zeros(settings.buckets, np.int64)
        counted = np.zeros(settings.buckets, bool)              # for a row of several pieces
        n = 0
        for batch in batches:
            n += batch.num_rows
            for p in _grams(batch.column(0), settings):
                last = len(p.off) - 2
                for i, (a, b) in enumerate(zip(p.off[:-1].tolist(), p.off[1:].tolist())):
                    grams = p.flat[a:b]
                    if p.goes_on and i == 0:
                        grams = grams[~counted[grams]]
                    place = np.arange(len(grams))
                    mark[grams] = place                         # the last place wins: one for each distinct n-gram
                    df[grams[mark[grams] == place]] += 1
                    if p.unfinished and i == last:
                        counted[grams] = True
                    elif p.goes_on and i == 0:
                        counted[:] = False
        block = 4096
        starts = list(range(0, settings.buckets, block))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*starts, -1], pa.int32()),
             pa.array([*(df[a: a + block].tobytes() for a in starts), np.array([n], np.int64).tobytes()], pa.binary())],
            names=["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [total.tobytes()]})

    blocks = docs.select("text").mapInArrow(returning_memory(count), "block int, counts binary")
    found = {r[0]: np.frombuffer(r[1], np.int64)
             for r in blocks.groupBy("block").applyInPandas(add, "block int, counts binary").collect()}
    n = int(found.pop(-1)[0]) if found else 0
    return n, np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(settings.buckets, np.int64)


def _features(docs: DataFrame, classes: list[str], settings: Settings) -> DataFrame:
    """part, class number, distinct features and their shares of each document."""
    number = {c: i for i, c in enumerate(classes)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                index, share = [b""] * batch.num_rows, [b""] * batch.num_rows
                held = None                                     # counts of a row of several pieces
                for p in _grams(batch.column(0), settings):
                    last = len(p.off) - 2
                    for i, (a, b) in enumerate(zip(p.off[:-1].tolist(), p.off[1:].tolist())):
                        if p.goes_on or (p.unfinished and i == last):
                            got = np.bincount(p.flat[a:b], minlength=settings.buckets)
                            held = got if held is None else held + got
                            if p.unfinished:
                                continue
                            u = np.flatnonzero(held)
                            c, held = held[u], None
                        else:
                            u, c = np.unique(p.flat[a:b], return_counts=True)
                        index[p.first + i] = u.astype("<i4").tobytes()
                        share[p.first + i] = (c / max(1, int(c.sum()))).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), pa.array([number[x] for x in batch.column(1).to_pylist()], pa.int32()),
                     pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["part", "label", "index", "share"])

    return docs.select("text", "lang", "part").mapInArrow(returning_memory(rows), "part int, label int, index binary, share binary")


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """FTRL-proximal weights of a state; L1 leaves small ones at exactly 0."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id",
          settings: Settings = Settings()) -> Model:
    """Fits the model on the rows of ``docs`` whose language and id are not null."""
    s = settings
    known = (docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key"))
             .filter(F.col("lang").isNotNull() & F.col("key").isNotNull()))
    counts = {r[0]: int(r[1]) for r in known.groupBy("lang").count().collect()}    # one row for each language
    classes = sorted(counts)
    if not classes:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, s)
    n_docs, df = document_frequencies(known, s)
    idf = np.log((n_docs + 1) / (df + 1)) + 1.0
    # a fixed share of each language, chosen by hash: about sample_docs rows in all
    each = s.sample_docs / len(classes)
    share = F.lit(0.0)
    for c in classes:
        share = F.when(F.col("lang") == c, F.lit(min(1.0, each / counts[c]))).otherwise(share)
    unit = lambda salt: F.pmod(F.xxhash64(F.col("key"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(unit(1) < share).withColumn("part", F.floor(unit(2) * F.lit(s.parts + 1)).cast("int"))
    rows = written(_features(sample, classes, s), "langid-sample")
    spark = docs.sparkSession
    k = len(classes)
    z, n = np.zeros((s.buckets + 1, k)), np.zeros((s.buckets + 1, k))
    idf_scaled = (idf * s.scale).astype(np.float64)

    def epoch_of(state):
        def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
            z, n = (a.copy() for a in state.value)
            # rows in an order that does not depend on how they were stored
            pdf = pdf.iloc[np.argsort([hash_of(x) for x in pdf["index"]], kind="stable")]
            for label, index, value in zip(pdf["label"], pdf["index"], pdf["share"]):
                i = np.frombuffer(index, "<i4")
                x = np.append(np.frombuffer(value, "<f4") * idf_scaled[i], 1.0)
                i = np.append(i, s.buckets)                      # the bias is a feature of every text
                w = _weights(z[i], n[i], s)
                g = _softmax(x @ w)
                g[label] -= 1.0
                g = x[:, None] * g
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * w
                n[i] += g * g
            return pd.DataFrame({"z": [z.astype("<f4").tobytes()], "n": [n.astype("<f4").tobytes()]})
        return epoch

    def mean_of(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = lambda c: sum(np.frombuffer(x, "<f4").astype(np.float64) for x in pdf[c]) / len(pdf)
        return pd.DataFrame({"z": [mean("z").astype("<f4").tobytes()], "n": [mean("n").astype("<f4").tobytes()]})

    for _ in range(s.epochs):
        state = spark.sparkContext.broadcast((z, n))             # buckets x classes
        states = rows.filter(F.col("part") < s.parts).groupBy("part").applyInPandas(epoch_of(state), "z binary, n binary")
        got = states.groupBy().applyInPandas(mean_of, "z binary, n binary").first()
        if got is None:
            break
        z, n = (np.frombuffer(x, "<f4").astype(np.float64).reshape(s.buckets + 1, k) for x in got)
    w = _weights(z, n, s)
    model = Model(classes, (w[:-1] * idf_scaled[:, None]).astype(np.float32), w[-1], 1.0, s)
    return Model(classes, model.weights, model.bias, fit_temperature(rows.filter(F.col("part") == s.parts), model), s)


def hash_of(data: bytes) -> int:
    import zlib
    return zlib.crc32(data)


def fit_temperature(rows: DataFrame, model: Model) -> float:
    """Temperature with the least log loss on feature rows; tasks return one sum for each candidate."""
    grid = np.geomspace(0.05, 20.0, 121)
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        total, seen = np.zeros(len(grid)), 0
        for pdf in batches:
            for label, index, value in zip(pdf["label"], pdf["index"], pdf["share"]):
                logits = np.frombuffer(value, "<f4") @ weights[np.frombuffer(index, "<i4")] + bias
                p = _softmax(logits[None, :] / grid[:, None])[:, label]
                total -= np.log(np.maximum(p, 1e-300))
                seen += 1
        if seen:
            yield pd.DataFrame({"at": np.arange(len(grid)), "loss": total})

    found = rows.select("label", "index", "share").mapInPandas(losses, "at int, loss double").groupBy("at").agg(
        F.sum("loss").alias("loss")).collect()
    return float(grid[min(found, key=lambda r: (r["loss"], r["at"]))["at"]]) if found else 1.0


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``carry`` (by new name), lang_pred and score of every row's whole text."""
    carry = carry or {}
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.weights, model.bias, model.temperature, model.settings))
    base = docs.select(F.col(text_col).alias("text"), *[c.alias(name) for name, c in carry.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights, bias, temperature, settings = shared.value
        names = pa.array([*classes, UNDETERMINED])
        tables = [np.ascontiguousarray(weights[:, c]) for c in range(len(classes))]
        for batch in batches:
            rows = batch.num_rows
            sums, size, letters = np.zeros((rows, len(classes))), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for p in _grams(batch.column(0), settings):
                here = np.flatnonzero(np.diff(p.off))
                for c, t in enumerate(tables):
                    if len(here):
                        sums[p.first + here, c] += np.add.reduceat(t[p.flat], p.off[here], dtype=np.float64)
                size[p.first: p.first + len(p.letters)] += np.diff(p.off)
                letters[p.first: p.first + len(p.letters)] += p.letters
            best = np.full(rows, len(classes), np.int64)
            score = np.zeros(rows)
            there = np.flatnonzero((letters > 0) & (size > 0))
            if len(there) and classes:
                p = _softmax((sums[there] / size[there, None] + bias) / temperature)
                best[there] = p.argmax(axis=1)
                score[there] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], names.take(pa.array(best)), pa.array(np.clip(score, 0.0, 1.0))],
                names=[*batch.schema.names[1:], "lang_pred", "score"])

    schema = base.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return base.mapInArrow(returning_memory(run), schema)
