"""Exact top-k by integer inner product as a Voronoi join.

Vectors become whole numbers (``floor(scale * x)``). A bounded set of pivots
parts the space into cells; queries are grouped by their nearest pivot, and so
are the data. A summary of each cell (rows and radius) gives bounds: for a
query q and a cell with pivot p and radius R, no product exceeds
``q.p + |q| R``. A first exact pass over each group's own cell gives every
query a score that its k-th best at least reaches. A cell whose bound stays
below that score is not joined with the query; all others are. The queries are
the smaller side, so they are what is replicated to the cells, and each block
of a cell is solved locally with matrix products. Cells are cut into blocks
of bounded size, and so are the queries that reach a cell, so a cell with a third
of all rows or queries is spread over many tasks.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; neither do rows without id; of two vectors the shorter one counts as
filled up with zeros; ties go to the smaller id; repeated ids are separate candidates,
and none of them is a candidate of a query with their id; fewer than k
candidates give fewer rows. Products are exact while they stay below 2**53,
else they are taken in Python integers; they must fit a long.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.frames import written

#: Pivots, chosen by hash: bounds every table of cells.
PIVOTS = 32
#: Rows of a cell that are solved together.
BLOCK_ROWS = 4096
#: Queries that travel together.
QUERY_BLOCK = 1024


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id and vec (array of long) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .filter(fine & (F.size(vector_col) > 0))
            .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vec")))


def _by_width(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(width) - width
    return [(at, flat[start[at][:, None] + np.arange(w)]) for w in np.unique(width).tolist() for at in [np.flatnonzero(width == w)]]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two integer matrices, over the columns that both have."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = min(x.shape[1], pivots.shape[1])
    return ((pivots * pivots).sum(1)[None, :] - 2.0 * (x[:, :width] @ pivots[:, :width].T)).argmin(axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller id; the lowest score is no candidate."""
    none = np.iinfo(np.int64).min
    if scores.shape[1] > k:                              # every column that reaches the k-th score stays for the ties
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= cut[:, None]) & (scores != none))
    else:
        row, col = np.nonzero(scores != none)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[rank < k], col[rank < k]


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest products with all rows but its own."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = written(integer_vectors(rows, id_col, vector_col, scale), "vectors")
    seeds = data.select("vec").orderBy(F.xxhash64("id", "vec"), "id").limit(pivots).collect()
    if not seeds:
        return spark.createDataFrame([], schema)
    width = max(len(r[0]) for r in seeds)
    centre = np.unique(np.array([r[0] + [0] * (width - len(r[0])) for r in seeds], np.float64), axis=0)
    shared = spark.sparkContext.broadcast(centre)               # pivots x width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, away, norm = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, x in _by_width(batch.column(1)):
                x = x.astype(np.float64)
                near = _nearest(x, p)
                both = min(x.shape[1], p.shape[1])
                beyond = (x[:, both:] ** 2).sum(1) + (p[near, both:] ** 2).sum(1)
                cell[at], norm[at] = near, np.sqrt((x * x).sum(1))
                away[at] = np.sqrt(((x[:, :both] - p[near, :both]) ** 2).sum(1) + beyond)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away), pa.array(norm)],
                names=["id", "vec", "cell", "away", "norm"])

    placed = written(data.mapInArrow(assign, "id long, vec array<long>, cell int, away double, norm double"), "cells")
    # summaries: one row for each cell
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()
    radius = {r["cell"]: r["radius"] for r in cells}

    def number(counts: dict[int, int], rows_each: int) -> Column:
        """Blocks of each cell."""
        out = F.lit(1)
        for c, n in counts.items():
            if n > rows_each:
                out = F.when(F.col("cell") == c, F.lit(-(-n // rows_each))).otherwise(out)
        return out

    block_count = number({r["cell"]: r["n"] for r in cells}, block_rows)
    in_blocks = placed.select("cell", F.pmod(F.xxhash64("id", F.col("away")), block_count).cast("int").alias("block"), "id", "vec")
    query_of = integer_vectors(rows.filter(F.coalesce(is_query, F.lit(False))), id_col, vector_col, scale)
    queries = query_of.mapInArrow(
        assign, "id long, vec array<long>, cell int, away double, norm double")
    queries = written(queries, "queries")

    def solve(key, queries_pdf: pd.DataFrame, data_pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries_pdf) or not len(data_pdf):
            return empty
        xs = _by_width(pa.array(data_pdf["vec"], pa.list_(pa.int64())))
        qid, xid = queries_pdf["id"].to_numpy(), data_pdf["id"].to_numpy()
        out = []
        for a in range(0, len(qid), QUERY_BLOCK):
            s = np.empty((len(qid[a: a + QUERY_BLOCK]), len(xid)), np.int64)
            for i, q in _by_width(pa.array(queries_pdf["vec"].iloc[a: a + QUERY_BLOCK], pa.list_(pa.int64()))):
                for j, x in xs:
                    s[np.ix_(i, j)] = _products(q, x)
            s[qid[a: a + QUERY_BLOCK, None] == xid[None, :]] = np.iinfo(np.int64).min
            r, c = _best(s, xid, k)
            out.append(pd.DataFrame({"query_id": qid[a: a + QUERY_BLOCK][r], "vec_id": xid[c], "score": s[r, c]}))
        return pd.concat(out) if out else empty

    local = "query_id long, vec_id long, score long"

    def joined(sent: DataFrame) -> DataFrame:
        """Local answers of queries (id, vec, cell): blocks of a cell's queries meet blocks of its rows."""
        sent = written(sent, "sent")
        parts = number({r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}, QUERY_BLOCK)
        asked = sent.select("id", "vec", "cell", F.pmod(F.xxhash64("id", "vec"), parts).cast("int").alias("part"),
                            F.explode(F.sequence(F.lit(0), block_count - 1)).alias("block"))
        held = in_blocks.select("id", "vec", "cell", "block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        key = ["cell", "block", "part"]
        return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(solve, local)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # the own cell first: exact, and a floor for each query's k-th score
    own = written(joined(queries.select("id", "vec", "cell")), "own-cells")
    floor = (own.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
             .groupBy("query_id").agg(F.min("score").alias("lowest"), F.count(F.lit(1)).alias("n"))
             .select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("lowest")).alias("floor")))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the other cells that may hold one of its k best."""
        p = shared.value
        numbers = np.array(sorted(radius))
        radii = np.array([radius[c] for c in numbers])
        for batch in batches:
            if not batch.num_rows:
                continue
            least = np.array([-np.inf if f is None else f for f in batch.column(3).to_pylist()])
            for at, x in _by_width(batch.column(1)):
                x = x.astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                both = min(x.shape[1], p.shape[1])
                bound = x[:, :both] @ p[numbers, :both].T + norm[:, None] * radii[None, :]
                bound += np.abs(bound) * 1e-9 + 1.0              # rounding must not drop a cell
                away = numbers[None, :] != batch.column(2).to_numpy()[at][:, None]
                r, c = np.nonzero((bound >= least[at][:, None]) & away)
                asking = pa.array(at[r])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(asking), batch.column(1).take(asking), pa.array(numbers[c], pa.int32())],
                    names=["id", "vec", "cell"])

    with_floor = queries.join(floor, "id", "left").select("id", "vec", "cell", "floor")
    others = joined(with_floor.mapInArrow(reach, "id long, vec array<long>, cell int"))
    return (own.unionByName(others).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
