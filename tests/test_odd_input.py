"""Hostile and odd input: nothing is lost and no job ends."""
import pytest
from pyspark.sql import functions as F

from sigspark.functions import bytes as fb
from sigspark.functions import jsonval as jv
from sigspark.operators import audit as au
from sigspark.operators import cascade as cs
from sigspark.operators import metrics as mt
from sigspark.operators import splits as sp
from sigspark.streaming import jobs


def test_empty_and_hostile_content(spark):
    mz = b"MZ" + bytes(58)
    rows = [(0, b""), (1, mz + b"\xff\xff\xff\xff"), (2, mz + b"\x40\x00\x00\x00" + b"PE\x00\x00"), (3, mz + b"\x41\x00\x00\x00" + b"PE\x00\x00"), (4, b"MZ")]
    df = spark.createDataFrame(rows, "id int, content binary").withColumn("h", fb.byte_histogram_udf(F.col("content")))
    got = {r.id: r for r in df.select("id", fb.is_pe_guess(F.col("content")).alias("pe"), fb.entropy_from_counts(F.col("h")).alias("e"),
                                      fb.normalize_counts(F.col("h")).alias("n")).collect()}
    assert [got[i].pe for i in range(5)] == [0, 0, 1, 0, 0]
    assert got[0].e == 0.0 and set(got[0].n) == {0.0}


@pytest.mark.parametrize("y", [0, 1])
def test_one_class_metrics(spark, y):
    df = spark.createDataFrame([(y, 0.1), (y, 0.7), (y, 0.7)], "y int, score double")
    assert mt.roc_curve(df).count() == 2
    r = mt.binary_curve_metrics(df).first()
    assert r.roc_auc is None and r.tpr_at_fpr_1pct is None


def labels(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.try_parse_json("t").alias("v"))
    return df.select(jv.normalize_labels(F.col("v")).alias("l"), jv.value_shape(F.col("v")).alias("s")).first()


def test_values(spark):
    assert labels(spark, '["a",["b",["c",["d"]]]]').l == ["a", "b", "c", "d"]
    assert (labels(spark, "1.0").s, labels(spark, "1.0").l) == ("float", ["1.0"])
    assert (labels(spark, "1").s, labels(spark, "1").l) == ("int", ["1"])
    assert (labels(spark, "1e30").s, labels(spark, "1e30").l) == ("float", ["1e+30"])
    assert labels(spark, "0.875").l == ["0.875"]
    assert labels(spark, "123456789012345678901234").s == "int"
    assert labels(spark, "[" * 9 + '"x"' + "]" * 9).l is None and labels(spark, '["a", ' + "[" * 8 + "]" * 9).l is None
    deep = spark.createDataFrame([("[" * 9 + '"x"' + "]" * 9,), ('["a"]',), ("null",), ('"a"',), (None,)], "t string")
    assert [r[0] for r in deep.select(jv.labels_too_deep(F.try_parse_json("t"))).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("text, hits, total", [('"5f/70d"', None, None), ('"5/70"', 5.0, 70.0), ('"3e1/70"', 30.0, 70.0), ('" 7 "', 7.0, None), ("4", 4.0, None)])
def test_detection_ratio(spark, text, hits, total):
    r = spark.createDataFrame([(text,)], "t string").select(jv.detection_ratio(F.try_parse_json("t")).alias("d")).first().d
    assert (r.hits, r.total) == (hits, total)


def test_blank_lines_are_not_malformed(spark):
    df = spark.createDataFrame([("train", "\t\r"), ("train", "  "), ("train", "{"), ("train", '{"label": -1}'), ("train", '{"label": 1}')], "split string, value string")
    parsed = au.parse_records(df)
    assert au.bad_rows(parsed).first().bad_json_rows == 1


def test_label_pivot_has_every_label(spark):
    df = spark.createDataFrame([("train", "-1"), ("train", "1"), ("test", None), ("test", "7")], "split string, label_s string")
    got = {r.split: r.asDict() for r in au.label_pivot(df).collect()}
    assert got["train"] == {"split": "train", "n_label_-1": 1, "n_label_1": 1, "n_label_7": 0, "n_label_null": 0}
    assert got["test"]["n_label_7"] == got["test"]["n_label_null"] == 1


def test_filetype_distribution_is_complete(spark):
    df = spark.createDataFrame([("train", f"t{i}") for i in range(20)], "split string, file_type string")
    assert au.filetype_distribution(df).count() == 20


def test_null_class_stays_in_splits(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(40)], "id int, y string")
    for out in (sp.stratified_split(df, "y", "id", 0.25), sp.train_val_split(df, "y", "id", 0.25)):
        rows = out.collect()
        assert len(rows) == 40
        assert sum(r.is_val for r in rows if r.y is None) == sum(r.is_val for r in rows if r.y) == 5
    assert sp.stratified_sample(df, "y", "id", 10).count() == 10


def test_split_moves_no_rows(spark):
    df = spark.createDataFrame([(i, str(i % 5), "payload") for i in range(100)], "id int, y string, payload string")
    plan = sp.stratified_split(df, "y", "id", 0.2)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange" in line and "payload" in line]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_without_score_stay_in_the_cascade(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", None)], "path string, s double")
    names = spark.createDataFrame([(0, "x"), (7, "z")], "id int, label string")
    layer1 = lambda d: d.withColumn("malware_score", F.col("s"))
    layer2 = lambda d: d.withColumn("family_scores", F.array(F.lit(0.2), F.lit(0.8)))
    classes = F.array(F.lit(0), F.lit(7))
    rows = {r.path: r for r in cs.cascade_predict(df, layer1, 0.5, layer2, names, classes).collect()}
    assert (rows["a"].is_malware, rows["a"].family_name) == (1, "z")
    assert (rows["b"].is_malware, rows["c"].is_malware) == (0, None)
    feats = df.select("path", "s", F.lit("h").alias("sha256"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("is_pe"))
    scanned = cs.scan_results(feats, layer1, 0.5, layer2, names, classes)
    assert {r.path: r.verdict for r in cs.verdict(scanned).collect()} == {"a": "malware", "b": "benign", "c": "undecided"}


def test_late_rows_are_dropped(spark, tmp_path):
    rows = lambda *d: spark.createDataFrame([(x, "k") for x in d], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    import time
    for i, day in enumerate((("2024-03-04", "2024-03-05"), ("2024-06-03",), ("2024-06-04",), ("2024-03-06", "2024-06-05"))):
        rows(*day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        time.sleep(1.1)
    stream = (spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t"))
    got = {(r.week_start, r.n) for r in jobs.drain(spark, jobs.week_counts(stream), ["week_start", "event_type"]).collect()}
    assert got == {("2024-03-04", 2), ("2024-06-03", 3)}
