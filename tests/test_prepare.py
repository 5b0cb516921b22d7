"""The prepare job and its readers: written tables, joins without a shuffle, faults, other sessions."""
import json

import pytest
from pyspark.sql import functions as F

from sigspark.operators import prepare as pr


def record(i, **more):
    return json.dumps({"sha256": f"{i % 40:064d}", "label": [0, 1, None][i % 3], "family": ["emo", "zeus", None, "rare"][i % 4] if i != 3 else "rare",
                       "general": {"size": i, "entropy": 1.5, "is_pe": 1, "start_bytes": [1, 2, 3, 4]}, **more})


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    raw, out = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("out")
    (raw / "2024_Win32_train.jsonl").write_text("\n".join([record(i) for i in range(60)] + ["", "{bad"]) + "\n")
    (raw / "2024_Win32_test.jsonl").write_text("\n".join(record(i) for i in range(60, 90)) + "\n")
    return pr.prepare(spark, str(raw), str(out / "d"), ("train", "test"), 10, buckets=5, blocks=["general"])


def test_tables_and_manifest(spark, prepared):
    f = {r.row_id: r for r in pr.open_table(spark, prepared, "features").collect()}
    y = {r.row_id: r for r in pr.open_table(spark, prepared, "binary").collect()}
    fam = {r.row_id: r.y for r in pr.open_table(spark, prepared, "family").collect()}
    assert len(f) == 90 and set(f) == set(y) == set(fam)
    ids = {"emo": 0, "zeus": 1, "rare": 2}                                      # 15, 15 and 15 or 16 training rows
    counts = {r.label: r.n for r in spark.read.schema("label string, id int, n long").json(prepared.folder + "/label_map").collect()}
    order = sorted(counts, key=lambda c: (-counts[c], c))
    ids = {c: i for i, c in enumerate(order)}
    for k, r in f.items():
        i = int(r.features[0])
        assert r.features == [i, 1.5, 1, 1, 2, 3, 4] and r.subset == ("train" if i < 60 else "test")
        assert y[k].y == [0, 1, -1][i % 3] and fam[k] == ids.get(r.family, -1)
    assert {t["n_rows"] for t in prepared.tables.values()} == {90} and {t["n_bad"] for t in prepared.tables.values()} == {1}


def test_tables_join_without_a_shuffle(spark, prepared):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = pr.read_vectors(spark, prepared, "train", "family")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_reopened_by_manifest_alone(spark, prepared):
    for t in prepared.tables.values():
        spark.sql(f"DROP TABLE {t['table']}")                                   # files stay: the tables are external
    again = pr.load_prepared(spark, prepared.folder)
    assert again.tables == prepared.tables
    rows, check = pr.read_vectors(spark, again, "test")
    assert rows.agg(F.sum(F.col("features")[0])).first()[0] == sum(range(60, 90))
    assert check.verify() == {"n": 30, "odd_width": 0, "no_label": 0}


def test_faults_are_raised(spark, prepared):
    wrong = pr.Prepared(prepared.folder, {**prepared.tables, "features": {**prepared.tables["features"], "width": 8}})
    rows, check = pr.read_vectors(spark, wrong)
    rows.agg(F.count(F.lit(1))).collect()
    with pytest.raises(ValueError, match="90 of 90 vectors are not 8 wide"):
        check.verify()
    check = pr.VectorCheck(1)
    check.watch(spark.createDataFrame([([1.0], 1), ([2.0], None)], "features array<double>, y int")).collect()
    with pytest.raises(ValueError, match="1 of 2 vectors have no row"):
        check.verify()
    with pytest.raises(ValueError, match="no file under"):
        pr.prepare(spark, prepared.folder, prepared.folder + "/none", ("train",))
