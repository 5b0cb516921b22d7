"""Hard negatives by angular triangle filtering.

An anchor's positives are its best-scored rows of the same label; a hard negative
of a positive is a row of another label whose score lies in a window below the
positive's (``low`` to ``high`` hundredths of it). Scores are integer inner
products of vectors turned into whole numbers (``floor(scale * x)``).

Every vector's norm and its angles to a bounded set of reference directions are
measured once and stored. The triangle inequality of angles then gives an
interval for the cosine of a pair that needs no product: the angle between a and
x lies between ``|angle(a,r) - angle(x,r)|`` and ``angle(a,r) + angle(x,r)`` (or
what is left of a full turn) for each direction r. Times the two norms, rounded
outwards, that bounds the score. Bounds are taken three times, each time for
less: for an anchor and a whole cell (the rows nearest to one direction), which
decides where the anchor is sent; for a run of anchors and each row of a block;
and for single pairs. Only what still overlaps the window is scored, with exact
integers.

Rows of a cell are dealt into blocks, and the anchors sent to a cell into parts,
by a number given out row by row, so neither a crowded cell nor a repeated id
lands in one task. A block keeps its best few rows for each anchor; the rest is a
rank over those. Blocks are no larger than the rows for each shuffle partition.

Defined cases: rows whose id, label or vector is null, or whose vector is empty
or holds null or non-finite components, take no part; of two vectors the shorter
counts as filled up with zeros, and a vector of zeros scores 0 with all; rows
with the anchor's id are neither its positives nor its negatives; equal anchor
rows (id, label and vector) count once, other repeated rows are separate
positives and negatives; ties go to the smaller id; positives with a score below
0 have an empty window; an empty table gives no rows. Further columns of the
input are ignored. Scores, times 100, must fit a long.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.frames import written
from sigspark.llm.topk import _best, _by_width, _products

#: Reference directions, chosen from a sample of ``SAMPLE`` rows: bounds every table of cells.
DIRECTIONS = 16
SAMPLE = 512
#: Largest block of rows and largest part of anchors that meet in one task.
BLOCK_ROWS = 16384
#: Anchors whose bounds and scores are held at once.
RUN = 64
#: Slack of an angle: stored angles are 32-bit numbers, and arccos of a rounded cosine is off by less.
SLACK = 1e-5

_NONE = np.iinfo(np.int64).min


def directions(sample: list[list[int]], n: int) -> np.ndarray:
    """Up to ``n`` unit vectors of the sample, each farthest in angle from those before it; one at least."""
    width = max((len(v) for v in sample), default=1)
    x = np.array([v + [0] * (width - len(v)) for v in sample], np.float64).reshape(len(sample), width)
    x = x[(x != 0).any(axis=1)]
    if not len(x):
        return np.eye(1, width)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:                          # only copies of the chosen ones are left
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    return x[chosen]


def measure(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to the references) of the rows of a matrix; a zero vector is at right angles to all."""
    both = min(x.shape[1], references.shape[1])
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = (x[:, :both] @ references[:, :both].T) / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.arccos(np.clip(cosine, -1.0, 1.0)).astype(np.float32)


def score_bounds(least: np.ndarray, most: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of pairs whose angle lies in [least, most] and whose product of norms in [short, long],
    rounded outwards."""
    top = np.cos(np.maximum(least - SLACK, 0.0))
    bottom = np.cos(np.minimum(most + SLACK, np.pi))
    high = np.where(top >= 0, long, short) * top
    low = np.where(bottom >= 0, short, long) * bottom
    return low - np.abs(low) * 1e-9 - 1.0, high + np.abs(high) * 1e-9 + 1.0


def angle_between(low_a, high_a, low_x, high_x):
    """Least and largest angle of two vectors whose angles to one direction lie in the given intervals."""
    least = np.maximum(np.maximum(low_a - high_x, low_x - high_a), 0.0)
    over = (low_a + low_x <= np.pi) & (high_a + high_x >= np.pi)
    most = np.where(over, np.pi, np.where(high_a + high_x < np.pi, high_a + high_x, 2 * np.pi - low_a - low_x))
    return least, most


def _matrix(column, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, np.float32) for v in column]).reshape(-1, width) if len(column) else np.zeros((0, width), np.float32)


def _negatives_of(scores: np.ndarray, ids: np.ndarray, wanted: list, low: int, high: int, n: int) -> Iterator[tuple]:
    """(place, negative, score): for each positive (place, score) the first rows of its window, best first."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    falling = -scores
    for place, positive in wanted:
        first = int(np.searchsorted(falling, -(high * positive // 100), side="left"))
        last = int(np.searchsorted(falling, low * positive // -100, side="right"))
        for i in range(first, min(last, first + n)):
            yield place, int(ids[i]), int(scores[i])


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         n_directions: int = DIRECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` and ``label`` are expressions over the input rows.
    """
    spark = rows.sparkSession
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    data = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"),
                        label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", fine))
            .select("id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("vec"), "label", "anchor"))
    sample = [r[0] for r in data.select("vec").orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).collect()]
    references = directions(sample, n_directions)
    n_refs = len(references)
    shared = spark.sparkContext.broadcast(references)            # directions x width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm, angle = np.zeros(n), np.zeros((n, n_refs), np.float32)
            for at, x in _by_width(batch.column(1)):
                norm[at], angle[at] = measure(x, shared.value)
            angles = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_refs, pa.int32()), pa.array(angle.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.arange(seen, seen + n), pa.int64()), pa.array(angle.argmin(axis=1), pa.int32()),
                 pa.array(norm), angles], names=[*batch.schema.names, "number", "cell", "norm", "angles"])
            seen += n

    placed = written(data.mapInArrow(
        place, "id long, vec array<long>, label long, anchor boolean, number long, cell int, norm double, angles array<float>"),
        "negatives-rows")
    bounds = [f(F.col("angles")[r]).alias(f"{n}{r}") for r in range(n_refs) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("short"), F.max("norm").alias("long"),
                                       *bounds).orderBy("cell").collect()           # one row for each direction at most
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not cells:
        return spark.createDataFrame([], schema)
    number = np.array([c["cell"] for c in cells], np.int32)
    low_angle = np.array([[c[f"lo{r}"] for r in range(n_refs)] for c in cells], np.float64)
    high_angle = np.array([[c[f"hi{r}"] for r in range(n_refs)] for c in cells], np.float64)
    short, long = np.array([c["short"] for c in cells]), np.array([c["long"] for c in cells])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = min(block_rows, max(256, -(-sum(c["n"] for c in cells) // tasks)))

    def dealt(counts: dict[int, int], size: int) -> Column:
        """Blocks of each cell."""
        out = F.lit(1)
        for cell, n in counts.items():
            if n > size:
                out = F.when(F.col("cell") == cell, F.lit(-(-n // size))).otherwise(out)
        return out

    blocks = dealt({c["cell"]: c["n"] for c in cells}, each)
    rows_in_blocks = placed.select("cell", F.pmod(F.xxhash64("number", "id"), blocks).cast("int").alias("block"),
                                   "id", "label", "vec", "norm", "angles")
    anchors = written(placed.filter("anchor").dropDuplicates(["id", "label", "vec"])
                      .select(F.monotonically_increasing_id().alias("akey"), "id", "label", "vec", "norm", "angles", "cell"),
                      "negatives-anchors")

    def meeting(sent: DataFrame, solve: Callable, found: str) -> DataFrame:
        """Local answers of anchors sent to cells: parts of a cell's anchors meet blocks of its rows."""
        sent = written(sent, "negatives-sent")
        parts = dealt({r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}, block_rows)
        asking = sent.withColumn("part", F.pmod(F.xxhash64("akey"), parts).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        held = rows_in_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        key = ["cell", "block", "part"]
        return asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(solve, found)

    pair_schema = "akey long, pid long, score long"

    def best_positives(key, a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """The best rows of the anchors' labels that can reach the anchors' floors."""
        out = [pd.DataFrame({"akey": [], "pid": [], "score": []}).astype("int64")]
        if len(a) and len(x):
            x = x.sort_values("label", kind="stable")
            x_label, x_id, x_norm, x_angle = x["label"].to_numpy(), x["id"].to_numpy(), x["norm"].to_numpy(), _matrix(x["angles"], n_refs)
            x_width = _by_width(pa.array(x["vec"], pa.list_(pa.int64())))
            for of, mine_ in a.groupby("label"):
                first, last = np.searchsorted(x_label, of, "left"), np.searchsorted(x_label, of, "right")
                here = [(j[k], m[k]) for j, m in x_width for k in [(j >= first) & (j < last)] if k.any()]
                for s in range(0, len(mine_) if here else 0, RUN):
                    run = mine_.iloc[s: s + RUN]
                    a_id, a_norm, a_angle = run["id"].to_numpy(), run["norm"].to_numpy(), _matrix(run["angles"], n_refs)
                    floor = run["floor"].to_numpy(dtype=np.float64, na_value=-np.inf)
                    for i, q in _by_width(pa.array(run["vec"], pa.list_(pa.int64()))):
                        for j, m in here:
                            least = np.zeros((len(i), len(j)))
                            if np.isfinite(floor[i]).all():
                                for r in range(n_refs):
                                    np.maximum(least, np.abs(a_angle[i, r, None] - x_angle[None, j, r]), out=least)
                            norms = a_norm[i, None] * x_norm[None, j]
                            may = score_bounds(least, least, norms, norms)[1] >= floor[i, None]
                            may &= a_id[i, None] != x_id[None, j]
                            cols = np.flatnonzero(may.any(axis=0))
                            if len(cols):
                                scores = np.where(may[:, cols], _products(q, m[cols]), _NONE)
                                r, c = _best(scores, x_id[j[cols]], positives)
                                out.append(pd.DataFrame({"akey": run["akey"].to_numpy()[i[r]], "pid": x_id[j[cols[c]]],
                                                         "score": scores[r, c]}))
        return pd.concat(out)

    best = Window.partitionBy("akey").orderBy(F.desc("score"), "pid")
    own = written(meeting(anchors.withColumn("floor", F.lit(None).cast("long")), best_positives, pair_schema), "negatives-own")
    floors = (own.withColumn("place", F.row_number().over(best)).filter(F.col("place") == positives)
              .select("akey", F.col("score").alias("floor")))

    def cell_bounds(norm: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of each vector with the rows of each cell."""
        least, most = np.zeros((len(norm), len(number))), np.full((len(norm), len(number)), np.pi)
        for r in range(n_refs):
            lo, hi = angle_between(angles[:, r, None], angles[:, r, None], low_angle[None, :, r], high_angle[None, :, r])
            np.maximum(least, lo, out=least)
            np.minimum(most, hi, out=most)
        return score_bounds(least, most, norm[:, None] * short[None, :], norm[:, None] * long[None, :])

    def reach(columns: list[str], wants: Callable) -> Callable:
        """Each anchor once for every cell that ``wants`` (batch, lowest, highest score with a cell) keeps."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    table = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                    angles = table["angles"].flatten().to_numpy().reshape(-1, n_refs)
                    r, c = np.nonzero(wants(table, *cell_bounds(table["norm"].to_numpy(), angles)))
                    yield pa.RecordBatch.from_arrays([*(table[n].take(pa.array(r)) for n in columns), pa.array(number[c])],
                                                     names=[*columns, "cell"])
        return run

    carried = ["akey", "id", "label", "vec", "norm", "angles"]
    carried_schema = "akey long, id long, label long, vec array<long>, norm double, angles array<float>"

    def beyond(table: dict, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        floor = table["floor"].cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        return (highest >= floor[:, None]) & (table["cell"].to_numpy()[:, None] != number[None, :])

    others = meeting(anchors.join(floors, "akey", "left").select(*carried, "cell", "floor").mapInArrow(
        reach([*carried, "floor"], beyond), carried_schema + ", floor long, cell int"), best_positives, pair_schema)
    chosen = written(own.unionByName(others).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives),
                     "negatives-positives")
    windows = (chosen.filter("score >= 0").groupBy("akey")
               .agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("wanted"),
                    (F.floor(F.max("score") * high / F.lit(100.0)) + 1).cast("long").alias("top"),        # a little wide: each
                    (F.ceil(F.min("score") * low / F.lit(100.0)) - 1).cast("long").alias("bottom")))      # window is exact later

    def overlap(table: dict, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        return (highest >= table["bottom"].to_numpy()[:, None]) & (lowest <= table["top"].to_numpy()[:, None])

    def window_negatives(key, a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """Of each anchor's windows the first rows of another label; only pairs whose bounds overlap a window are scored."""
        found: list[tuple] = []
        if len(a) and len(x):
            cell = int(key[0])
            x_label, x_id, x_norm, x_angle = x["label"].to_numpy(), x["id"].to_numpy(), x["norm"].to_numpy(), _matrix(x["angles"], n_refs)
            x_width = _by_width(pa.array(x["vec"], pa.list_(pa.int64())))
            a_angles = _matrix(a["angles"], n_refs)
            a = a.iloc[np.lexsort((a_angles[:, cell], a_angles.argmin(axis=1)))]      # a run's anchors point alike
            for s in range(0, len(a), RUN):
                run = a.iloc[s: s + RUN]
                a_norm, a_angle = run["norm"].to_numpy(), _matrix(run["angles"], n_refs)
                near = a_angle.argmin(axis=1)
                bottom, top = run["bottom"].to_numpy(), run["top"].to_numpy()
                # all rows of the block, against the run as a whole
                least, most = np.zeros(len(x_id)), np.full(len(x_id), np.pi)
                for r in range(n_refs):
                    lo, hi = angle_between(a_angle[:, r].min(), a_angle[:, r].max(), x_angle[:, r], x_angle[:, r])
                    np.maximum(least, lo, out=least)
                    np.minimum(most, hi, out=most)
                lowest, highest = score_bounds(least, most, a_norm.min() * x_norm, a_norm.max() * x_norm)
                open_ = (highest >= bottom.min()) & (lowest <= top.max())
                for j, m in x_width:
                    j, m = j[open_[j]], m[open_[j]]
                    if not len(j):
                        continue
                    for i, q in _by_width(pa.array(run["vec"], pa.list_(pa.int64()))):
                        # single pairs, by the cell's direction and the anchor's own
                        least, most = angle_between(a_angle[i, cell, None], a_angle[i, cell, None], x_angle[None, j, cell], x_angle[None, j, cell])
                        own_angle, its = a_angle[i, near[i]][:, None], x_angle[j][:, near[i]].T
                        lo, hi = angle_between(own_angle, own_angle, its, its)
                        norms = a_norm[i, None] * x_norm[None, j]
                        lowest, highest = score_bounds(np.maximum(least, lo), np.minimum(most, hi), norms, norms)
                        may = (highest >= bottom[i, None]) & (lowest <= top[i, None])
                        may &= run["label"].to_numpy()[i, None] != x_label[None, j]
                        may &= run["id"].to_numpy()[i, None] != x_id[None, j]
                        cols = np.flatnonzero(may.any(axis=0))
                        if not len(cols):
                            continue
                        scores = _products(q, m[cols])
                        may = may[:, cols] & (scores >= bottom[i, None]) & (scores <= top[i, None])
                        for k in np.flatnonzero(may.any(axis=1)).tolist():
                            at = np.flatnonzero(may[k])
                            wanted = [(w["place"], w["score"]) for w in run["wanted"].iloc[i[k]]]
                            akey = int(run["akey"].iloc[i[k]])
                            found += [(akey, *f) for f in _negatives_of(scores[k, at], x_id[j[cols[at]]], wanted, low, high, negatives)]
        return pd.DataFrame(found, columns=["akey", "place", "nid", "score"])

    sent = anchors.join(windows, "akey").mapInArrow(
        reach([*carried, "wanted", "top", "bottom"], overlap),
        carried_schema + ", wanted array<struct<place:int,score:long>>, top long, bottom long, cell int")
    near = meeting(sent, window_negatives, "akey long, place int, nid long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("akey", "place").orderBy(F.desc("score"), "nid")))
    names = anchors.select("akey", F.col("id").alias("anchor_id"))
    return (ranked.filter(F.col("rank") <= negatives)
            .join(chosen.select("akey", "place", F.col("pid").alias("positive_id"), F.col("score").alias("positive_score")), ["akey", "place"])
            .join(names, "akey")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("nid").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
