"""Rows are scored once for a report, however many metrics read the scores."""
import pytest
from pyspark.sql import functions as F

from sigspark.operators import metrics as mt
from sigspark.operators import ml

N = 60


@pytest.fixture
def counted(spark):
    """(sha256, y, x, features): x and features come from a Python function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def value(i):
        calls.add(1)
        return float((i * 37) % 101) / 101 + (i % 2) * 0.4

    x = F.udf(value, "double")("id")
    d = spark.range(N).select(F.col("id").cast("string").alias("sha256"), (F.col("id") % 2).cast("int").alias("y"), x.alias("x"))
    return d, d.select("sha256", "y", F.array(F.col("x"), F.col("y") * 0.5).cast("array<float>").alias("features")), calls


def _calls(calls, do):
    before = calls.value
    out = do()
    return out, calls.value - before


def test_metrics_read_the_scores_once(counted):
    d, _, calls = counted
    r, n = _calls(calls, lambda: mt.binary_curve_metrics(d, "y", "x").first())
    assert n == N and 0.5 < r.roc_auc < 1
    r, n = _calls(calls, lambda: mt.best_f1_threshold(d, "y", "x").first())
    assert n == N and 0.5 < r.f1 <= 1
    rows, n = _calls(calls, lambda: mt.roc_curve(d, "y", "x").collect())
    assert n == N and rows
    found, n = _calls(calls, lambda: mt.exact_quantiles(d, "x", [0.0, 0.5, 1.0]).collect())
    assert n == N and len(found) == 3


def test_evaluation_scores_rows_once(counted, spark):
    _, rows, calls = counted
    train = spark.createDataFrame([(str(i), i % 2, [float(i % 7), float(i % 2)]) for i in range(40)],
                                  "sha256 string, y int, features array<float>")
    m = ml.train_classifier(train, "logreg", {"maxIter": 5}, "binary", seed=3)
    r, n = _calls(calls, lambda: ml.evaluate(m, rows).first())
    assert n == N and r.eval_rows_total_before_y_filter == N and r.roc_auc == 1.0
