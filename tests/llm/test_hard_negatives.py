"""Hard negatives against brute force: odd rows, ties, crowded cells, every bound."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 2) for i, v, y in rows], SCHEMA).repartition(3)


def found(spark, rows, **settings):
    got = hn.mine(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), **settings)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def plain(rows, n=5):
    good = []
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y))
    anchors = {(i, tuple(v), y) for i, v, y in good if i % 10 == 0}
    out = []
    for i, v, y in anchors:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for j, w, z in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == y][:n]:
            fit = [(t, k) for t, k, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:n]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fit)]
    return sorted(out)


def vectors(n, width=8, seed=3):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(4, width))
    return [(i, (centre[i % 4] + rnd.normal(size=width) * rnd.choice([0.1, 0.8])).round(2).tolist(), int(rnd.integers(0, 3))) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(300)
    want = plain(rows)
    assert len(want) > 300
    assert found(spark, rows) == want
    # many small blocks and parts, one direction only
    assert found(spark, rows, block_rows=7, n_directions=1) == want


def test_odd_rows_ties_and_widths(spark):
    rnd = random.Random(4)
    rows = vectors(60, 4)
    rows += [(i, [0.5, 0.5, 0.25, 0.25], i % 3) for i in range(60, 90)]                     # ties and a crowded cell
    rows += [(90, [], 1), (91, None, 1), (92, [1.0, None], 0), (93, [float("nan")] * 4, 0), (94, [float("inf")] * 4, 2),
             (None, [1.0] * 4, 1), (96, [1.0] * 4, None), (100, [0.0] * 4, 1), (97, [0.0] * 4, 2), (110, [-1.0] * 4, 9),
             (98, [0.5, 0.5], 0), (120, [0.5, 0.5, 0.25, 0.25, 3.0, 0.125], 1), (130, [2.0], 2)]
    rows += rows[:20] + rows[60:64] + rows[-2:]                                             # repeated rows, anchors among them
    rnd.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_nothing_to_mine(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [0.0], 1), (11, [0.0], 1), (12, [0.0], 2)]) == [(10, 11, 1, 12, 0, 0)]
    assert found(spark, [(10, [1.0], 1)]) == [] and found(spark, [(11, [1.0], 1)]) == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_for_every_pair(seed):
    rnd = np.random.default_rng(seed)
    x = (rnd.normal(size=(200, 6)) * rnd.choice([1, 300, 1e5], size=(200, 1))).astype(np.int64)
    x[:3] = 0
    x[3:6] = x[6:9] * -1
    x[9:12] = x[12:15] * 2
    references = hn.directions(x[:50].tolist(), 4)
    norm, angle = hn.measure(x, references)
    least, most = np.zeros((200, 200)), np.full((200, 200), np.pi)
    for r in range(len(references)):
        lo, hi = hn.angle_between(angle[:, r, None], angle[:, r, None], angle[None, :, r], angle[None, :, r])
        least, most = np.maximum(least, lo), np.minimum(most, hi)
    lowest, highest = hn.score_bounds(least, most, np.outer(norm, norm), np.outer(norm, norm))
    exact = (x.astype(object) @ x.T.astype(object)).astype(np.float64)
    assert (lowest <= exact).all() and (exact <= highest).all()
    assert (highest < exact.max() / 4).any()                                # and they do exclude something
