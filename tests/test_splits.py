from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sigspark.operators import labels as lb
from sigspark.operators import ordering, splits as sp


def test_stratified_split_quota_and_partition(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else "c")) for i in range(301)] + [(1000, "single")]
    df = spark.createDataFrame(rows, "id int, y string")
    out = sp.stratified_split(df, "y", "id", 0.2, seed=1).collect()
    assert len(out) == len(rows) and len({r["id"] for r in out}) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["y"], []).append(r["is_val"])
    for c, flags in by.items():
        n = len(flags)
        assert sum(flags) == min(max(1, round(n * 0.2)), n - 1), c


def test_stratified_sample_exact_size(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(1000)], "id int, y int")
    s = sp.stratified_sample(df, "y", "id", 101, seed=2)
    assert s.count() == 101
    assert sp.stratified_sample(df, "y", "id", 5000).count() == 1000


def test_global_positions_and_running_sums(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 20, 500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id int, v int")
    pos = ordering.positions(df, ["v", "id"]).orderBy("pos").collect()
    assert [r["pos"] for r in pos] == list(range(500))
    assert [r["v"] for r in pos] == sorted(v.tolist())
    rs = ordering.running_sums(df, ["v", "id"], ["v"], descending=True).toPandas().sort_values(["v", "id"], ascending=False)
    assert (rs["cum_v"].to_numpy() == rs["v"].cumsum().to_numpy()).all()


def test_class_weights_bounds(spark):
    df = spark.createDataFrame([(i, 0 if i < 990 else 1) for i in range(1000)], "id int, y int")
    w = {r["y"]: r["weight"] for r in sp.class_weights(df, "y", "balanced", 20.0).collect()}
    assert abs(w[0] - 1000 / (2 * 990)) < 1e-12 and w[1] == 20.0


def test_label_map_tie_break_and_filters(spark):
    rows = [("b",)] * 12 + [("a",)] * 12 + [("win32",)] * 50 + [("c",)] * 3 + [(None,)]
    df = spark.createDataFrame(rows, "family string")
    m = {r["label"]: r["id"] for r in lb.build_label_map(df, "family", 10).collect()}
    assert m == {"a": 0, "b": 1}


def test_stratified_sample_is_exact_with_repeated_keys(spark):
    rows = [(i % 17, None if i % 4 == 3 else i % 4, i // 60) for i in range(200)]              # few keys, a null class, equal rows
    df = spark.createDataFrame(rows, "id int, y int, z int").repartition(3)
    for size in (1, 30, 57, 199):
        s = [tuple(r) for r in sp.stratified_sample(df, "y", "id", size, seed=2).collect()]
        assert len(s) == size and not Counter(s) - Counter(rows)
    again = [sorted(map(str, sp.stratified_sample(df.repartition(n), "y", "id", 30, seed=2).collect())) for n in (1, 5)]
    assert again[0] == again[1]
    one = spark.createDataFrame([(1, 0)] * 50, "id int, y int")
    assert sp.stratified_sample(one, "y", "id", 20).count() == 20


def test_range_buckets_compare_in_two_steps(spark):
    from sigspark.operators.ordering import range_bucket
    df = spark.range(0, 5000, 1, 4).select((F.col("id") * 7919 % 5000).alias("a"), F.col("id").alias("b"))
    for n in (2, 3, 50, 200):
        for descending in (False, True):
            got = df.select("a", "b", range_bucket(df, ["a", "b"], n, descending).alias("x")).collect()
            ids = [r["x"] for r in sorted(got, key=lambda r: (r["a"], r["b"]), reverse=descending)]
            assert ids == sorted(ids) and set(ids) == set(range(n))
    nulls = spark.createDataFrame([(None,), (1,), (2,)], "a int")
    assert {r[0]: r[1] for r in nulls.select("a", range_bucket(nulls, ["a"], 2)).collect()}[None] == 0
    plan = df.select(range_bucket(df, ["a", "b"], 200).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 2                               # the heads of the runs, then one run
