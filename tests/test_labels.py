import pytest
from pyspark.sql import functions as F

from sigspark.operators import labels as lb


@pytest.fixture(scope="module")
def label_map(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 4)], "label string, id int")


def test_multihot_small(spark, label_map):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, None), (3, []), (4, ["x", None]), (5, ["c", "b"])],
                               "id int, l array<string>")
    got = {r["id"]: r["y_multi"] for r in lb.multihot(df, "id", "l", label_map).collect()}
    zero = [0] * 5
    assert got == {1: [1, 1, 0, 0, 0], 2: zero, 3: zero, 4: zero, 5: [0, 1, 0, 0, 1]}
    assert {len(r["y_multi"]) for r in lb.multihot(df, "id", "l", label_map, k=7).collect()} == {7}
    assert [r["y_multi"] for r in lb.multihot(df, "id", "l", label_map.where("id > 9")).collect()] == [[]] * 5
    with pytest.raises(Exception, match="out of bounds"):
        lb.multihot(df, "id", "l", label_map, k=3).collect()


def test_multihot_wide_batches_stay_small(spark):
    """4,000 rows x 60,000 labels: the whole grid would be 960 MB in one batch of a worker."""
    k = 60_000
    labels = spark.range(k).select(F.col("id").cast("string").alias("label"), F.col("id").cast("int"))
    df = spark.range(0, 4_000, 1, 1).select("id", F.array((F.col("id") * 15).cast("string")).alias("l"))
    out = lb.multihot(df, "id", "l", labels).select("id", F.array_position("y_multi", 1).alias("at"), F.size("y_multi").alias("k"))

    r = out.agg(F.count_if((F.col("at") != F.col("id") * 15 + 1) | (F.col("k") != k)).alias("wrong")).first()
    assert r["wrong"] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "y_multi" not in plan.split("ArrowEvalPython")[1]      # the wide column is not made in Python


def test_dense_from_ids(spark):
    df = spark.createDataFrame([([3, 0, 3],), ([],), (None,), ([4],)], "ids array<int>")
    assert [list(r[0]) for r in df.select(lb.dense_from_ids(F.col("ids"), 5)).collect()] == [
        [1, 0, 0, 1, 0], [0] * 5, [0] * 5, [0, 0, 0, 0, 1]]
