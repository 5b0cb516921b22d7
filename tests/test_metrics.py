import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import metrics as mt


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.6 + y * 0.3, 2)  # ties on purpose
    return y, s, spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")


def _auc_ref(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def _ap_ref(y, s):
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        pred = s >= t
        tp = np.sum(pred & (y == 1))
        r, p = tp / np.sum(y == 1), tp / np.sum(pred)
        ap += (r - prev_r) * p
        prev_r = r
    return ap


def test_auc_ap(scored):
    y, s, df = scored
    r = mt.binary_curve_metrics(df).first()
    assert abs(r["roc_auc"] - _auc_ref(y, s)) < 1e-12
    assert abs(r["pr_auc"] - _ap_ref(y, s)) < 1e-12


def test_auc_of_flipped_scores(scored):
    _, _, df = scored
    a = mt.binary_curve_metrics(df).first()["roc_auc"]
    b = mt.binary_curve_metrics(df.withColumn("score", 1 - F.col("score"))).first()["roc_auc"]
    assert abs(a + b - 1) < 1e-12


def test_best_f1_threshold(scored):
    y, s, df = scored
    r = mt.best_f1_threshold(df).first()
    best_t, best_f = 0.5, -1.0
    for t in np.unique(np.quantile(s, np.linspace(0.01, 0.99, 99))):
        pred = s >= t
        tp, fp, fn = np.sum(pred & (y == 1)), np.sum(pred & (y == 0)), np.sum(~pred & (y == 1))
        f = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        if f > best_f:
            best_f, best_t = f, float(t)
    assert abs(r["f1"] - best_f) < 1e-12 and abs(r["threshold"] - best_t) < 1e-12


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.random(997)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    qs = [0.01, 0.25, 0.5, 0.99]
    got = {r["q"]: r["value"] for r in mt.exact_quantiles(df, "x", qs).collect()}
    for q in qs:
        assert abs(got[q] - np.quantile(v, q)) < 1e-15


def test_f1_macro_weighted(spark):
    y = [0, 0, 1, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 2, 0, 3]
    df = spark.createDataFrame(list(zip(y, p)), "y int, pred int")
    r = mt.f1_macro_weighted(df).first()
    classes = sorted(set(y) | set(p))
    f1s, sup = [], []
    for c in classes:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        fp = sum(1 for a, b in zip(y, p) if a != c and b == c)
        fn = sum(1 for a, b in zip(y, p) if a == c and b != c)
        f1s.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
        sup.append(sum(1 for a in y if a == c))
    assert abs(r["f1_macro"] - np.mean(f1s)) < 1e-12
    assert abs(r["f1_weighted"] - np.dot(f1s, sup) / sum(sup)) < 1e-12
