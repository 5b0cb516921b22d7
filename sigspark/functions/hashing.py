"""Feature hashing of token lists into fixed-width vectors.

Bucket rule (the public scikit-learn FeatureHasher behaviour): h =
MurmurHash3_x86_32(utf8(token), seed 0) as a signed int32; index = |h| mod n;
with ``signed`` the value is multiplied by +1 when h >= 0 else -1. Pair
tokens (name, value) hash ``name`` with weight ``value`` (string values hash
``name=value`` with weight 1).

Spark's own ``hash()`` is Murmur3 with seed 42 and a different tail rule, so
the hot path is an Arrow ``pandas_udf`` with a numpy Murmur3 vectorised over
all tokens of a batch (tokens grouped by block count, one numpy pass per
block position). ``md5`` mode is a pure-SQL twin (first 32 bits of md5) used
where an independent SQL engine has to recompute the vectors.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C1 = np.uint32(0xCC9E2D51)
_C2 = np.uint32(0x1B873593)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _fmix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def murmur3_32(tokens: list[bytes], seed: int = 0) -> np.ndarray:
    """Signed 32-bit MurmurHash3 (x86) of every byte string, vectorised."""
    n = len(tokens)
    out = np.zeros(n, dtype=np.uint32)
    if n == 0:
        return out.astype(np.int32)
    lens = np.fromiter((len(t) for t in tokens), dtype=np.int64, count=n)
    nblocks = lens // 4
    with np.errstate(over="ignore"):
        for nb in np.unique(nblocks):
            idx = np.nonzero(nblocks == nb)[0]
            h = np.full(len(idx), seed, dtype=np.uint32)
            if nb > 0:
                body = np.frombuffer(b"".join(tokens[i][:4 * nb] for i in idx), dtype="<u4").reshape(len(idx), nb)
                for j in range(nb):
                    k = body[:, j].copy()
                    k *= _C1
                    k = _rotl(k, 15)
                    k *= _C2
                    h ^= k
                    h = _rotl(h, 13)
                    h = h * np.uint32(5) + np.uint32(0xE6546B64)
            tail_len = lens[idx] - 4 * nb
            k1 = np.zeros(len(idx), dtype=np.uint32)
            for pos in (2, 1, 0):
                has = tail_len > pos
                if has.any():
                    vals = np.array([tokens[i][4 * nb + pos] if tl > pos else 0 for i, tl in zip(idx, tail_len)],
                                    dtype=np.uint32)
                    k1 ^= np.where(has, vals << np.uint32(8 * pos), np.uint32(0)).astype(np.uint32)
            has_tail = tail_len > 0
            k1 *= _C1
            k1 = _rotl(k1, 15)
            k1 *= _C2
            h = np.where(has_tail, h ^ k1, h).astype(np.uint32)
            h ^= lens[idx].astype(np.uint32)
            out[idx] = _fmix(h)
    return out.view(np.int32)


def bucket_and_sign(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    h64 = h.astype(np.int64)
    idx = np.where(h64 == -2147483648, (2147483647 - (n - 1)) % n, np.abs(h64) % n)
    sign = np.where(h64 >= 0, 1.0, -1.0)
    return idx.astype(np.int64), sign


def hash_rows(rows, n: int, signed: bool) -> np.ndarray:
    """Dense (len(rows), n) float32 matrix; each row is a list of (token, weight)."""
    counts = np.fromiter((len(r) if r is not None else 0 for r in rows), dtype=np.int64, count=len(rows))
    toks = [t.encode("utf-8") for r in rows if r is not None for t, _ in r]
    wts = np.fromiter((w for r in rows if r is not None for _, w in r), dtype=np.float64, count=int(counts.sum()))
    out = np.zeros((len(rows), n), dtype=np.float64)
    if toks:
        idx, sign = bucket_and_sign(murmur3_32(toks), n)
        row = np.repeat(np.arange(len(rows)), counts)
        vals = wts * (sign if signed else 1.0)
        np.add.at(out, (row, idx), vals)
    return out.astype(np.float32)


#: Rows whose tokens are Python objects at one time; an Arrow batch may hold 10,000.
PIECE_ROWS = 64


def in_pieces(column: pa.Array, width: int, vectors) -> pa.ListArray:
    """``vectors`` of ``PIECE_ROWS`` rows (as Python values) at a time -> ARRAY<FLOAT>(width) for each row."""
    out = np.zeros((len(column), width), dtype=np.float32)
    for i in range(0, len(column), PIECE_ROWS):
        out[i:i + PIECE_ROWS] = vectors(list(column.slice(i, PIECE_ROWS).to_pandas()))
    offsets = np.arange(len(column) + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))


def _string_rows(values) -> list:
    return [[(t, 1.0) for t in r if t is not None] if r is not None else [] for r in values]


def _pair_rows(values) -> list:
    return [[(p["k"], float(p["v"]) if p["v"] is not None else 0.0) for p in r] if r is not None else [] for r in values]


def feature_hash_strings(tokens: Column, n: int, signed: bool = True) -> Column:
    """``fn_feature_hash`` over ARRAY<STRING> (each token weight 1) -> ARRAY<FLOAT>(n)."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _h(s: pa.Array) -> pa.Array:
        return in_pieces(s, n, lambda rows: hash_rows(_string_rows(rows), n, signed))
    return _h(tokens)


def feature_hash_pairs(pairs: Column, n: int, signed: bool = True) -> Column:
    """``fn_feature_hash`` over ARRAY<STRUCT<k STRING, v DOUBLE>> -> ARRAY<FLOAT>(n)."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _h(s: pa.Array) -> pa.Array:
        return in_pieces(s, n, lambda rows: hash_rows(_pair_rows(rows), n, signed))
    return _h(pairs)


# ---- pure SQL twin ------------------------------------------------------------------------------

def md5_32(token: Column) -> Column:
    """Signed 32-bit hash from the first 8 hex digits of md5 (SQL-reproducible)."""
    u = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.when(u >= 2 ** 31, u - 2 ** 32).otherwise(u)


#: Cells that are summed from one part of the tokens.
GROUP = 8


def feature_hash_sql(pairs: Column, n: int, signed: bool = True) -> Column:
    """Same bucket rule with ``md5_32`` instead of Murmur3, as one JVM expression.

    Every token is hashed once, the tokens are dealt to groups of ``GROUP`` cells, and each cell sums those of its
    group in their order. Lambda variables hold what is read more than once (an expression would be evaluated again)."""
    def cell(p):
        idx = F.when(p["h"] == -2147483648, F.lit((2147483647 - (n - 1)) % n)).otherwise(F.abs(p["h"]) % n).cast("int")
        v = p["v"] * (F.when(p["h"] >= 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0))
        return F.struct(idx.alias("i"), v.alias("v"))

    first = F.transform(pairs, lambda p: F.struct(F.conv(F.substring(F.md5(p["k"]), 1, 8), 16, 10).cast("bigint").alias("u"), p["v"].alias("v")))
    hashed = F.transform(first, lambda p: F.struct(F.when(p["u"] >= 2 ** 31, p["u"] - 2 ** 32).otherwise(p["u"]).alias("h"), p["v"].alias("v")))
    groups = F.transform(F.array(F.transform(hashed, cell)), lambda cells: F.when(cells.isNotNull(), F.transform(
        F.sequence(F.lit(0), F.lit((n - 1) // GROUP)),
        lambda g: F.struct((g * GROUP).alias("from"), F.filter(cells, lambda c: (c["i"] >= g * GROUP) & (c["i"] < (g + 1) * GROUP)).alias("of")))))
    sums = F.transform(F.flatten(groups), lambda g: F.transform(
        F.sequence(F.lit(0), F.lit(GROUP - 1)),
        lambda j: F.aggregate(g["of"], F.lit(0.0), lambda a, c: a + F.when(c["i"] == g["from"] + j, c["v"]).otherwise(0.0)).cast("float")))
    return F.slice(F.flatten(sums), 1, n)


def string_pairs(tokens: Column) -> Column:
    """ARRAY<STRING> -> pairs with weight 1."""
    return F.transform(tokens, lambda t: F.struct(t.alias("k"), F.lit(1.0).alias("v")))


def feature_hash_many(specs: list[tuple[str, Column, int, bool]]) -> Column:
    """Several token lists hashed by one Arrow UDF: ``specs`` are (kind, tokens,
    width, signed) with kind ``strings`` or ``pairs``; the result is the
    concatenation of the hashed vectors in order (one Python evaluation per
    batch instead of one per list)."""
    kinds = [(k, n, s) for k, _, n, s in specs]

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _hm(frame: pa.Array) -> pa.Array:
        def vectors(rows):
            parts = []
            for j, (kind, n, signed) in enumerate(kinds):
                values = [r[f"t{j}"] for r in rows]
                parts.append(hash_rows(_pair_rows(values) if kind == "pairs" else _string_rows(values), n, signed))
            return np.concatenate(parts, axis=1)
        return in_pieces(frame, sum(n for _, n, _ in kinds), vectors)

    # a single struct argument: the planner handles one lambda-built input per UDF
    return _hm(F.struct(*[t.alias(f"t{j}") for j, (_, t, _, _) in enumerate(specs)]))
