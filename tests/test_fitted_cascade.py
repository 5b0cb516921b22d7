"""Passive-aggressive steps against a plain loop; fitted cascades, applied, saved and loaded."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import fitted_cascade as fc
from sigspark.operators import ml
from sigspark.operators import splits as sp
from sigspark.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(4, 6)) * 2
    data = []
    for i in range(400):
        c = int(rnd.integers(0, 4))
        x = centre[c] + rnd.normal(size=6)
        data.append((f"{i:04d}", [float(v) for v in x] , c, int(c >= 1), c - 1 if c >= 1 else -1))
    return spark.createDataFrame(data, "sha256 string, features array<double>, y int, y_bin int, y_fam int")


def test_passive_aggressive_equals_a_plain_loop(spark, rows):
    data = rows.where("y < 3")
    model = ml.train_passive_aggressive(data, epochs=3, aggressiveness=0.05, class_weight_mode=None, seed=7, parts=1)
    got = data.orderBy("sha256").collect()
    x = np.array([r.features for r in got])
    x = x / x.std(axis=0)
    w, mean = np.zeros((3, 7)), np.zeros((3, 7))
    for epoch in range(1, 4):
        keyed = {r.sha256: r.k for r in data.select("sha256", sp.order_key(f"7|{epoch}", "sha256").alias("k")).collect()}
        total = np.zeros((3, 7))
        for i in sorted(range(len(got)), key=lambda i: keyed[got[i].sha256]):
            row = [*x[i], 1.0]
            s = [sum(a * b for a, b in zip(w[c], row)) for c in range(3)]
            rival = max((c for c in range(3) if c != got[i].y), key=lambda c: s[c])
            loss = max(0.0, 1 - s[got[i].y] + s[rival])
            step = min(0.05, loss / (2 * sum(v * v for v in row)))
            for j, v in enumerate(row):
                w[got[i].y][j] += step * v
                w[rival][j] -= step * v
            total += w
        mean += total / len(got) / 3
    assert model.classes == [0, 1, 2] and np.allclose(model.weights, mean, atol=1e-8)


def test_passive_aggressive_as_a_model_slot(spark, rows):
    for kind in ("passive_aggressive", "stream_linear"):
        model = ml.train_classifier(rows, kind, {"epochs": 3}, "multiclass", 0.2)
        path = scratch_path(spark, f"model-{kind}")
        ml.save_model(spark, model, path)
        again = ml.load_model(spark, path)
        a, b = (sorted((r.sha256, r.scores) for r in ml.scores_of(m, rows).select("sha256", "scores").collect()) for m in (model, again))
        assert a == b
        assert ml.evaluate(again, rows).first()["accuracy"] > 0.85
    binary = ml.train_classifier(rows, "passive_aggressive", {}, "binary", 0.2, y="y_bin")
    assert binary.validation_f1 > 0.9 and ml.evaluate(binary, rows, "y_bin").first()["roc_auc"] > 0.95
    one = ml.train_passive_aggressive(rows.where("y = 2"))
    assert one.classes == [2] and not one.weights.any()


def test_cascade_of_fitted_layers(spark, rows):
    names = spark.createDataFrame([("emo", 0), ("zeus", 1)], "label string, id int")
    cascade = fc.fit_cascade(rows, ("logreg", {"maxIter": 30}), ("passive_aggressive", {"epochs": 3}), label_map=names)
    first = {r.sha256: r.score for r in ml.scores_of(cascade.layer1, rows).collect()}
    second = {r.sha256: r.scores for r in ml.scores_of(cascade.layer2, rows).collect()}
    got = {r.sha256: r for r in fc.predict(cascade, rows).collect()}
    assert len(got) == 400
    for k, r in got.items():
        assert r.malware_score == first[k] and r.is_malware == int(first[k] >= cascade.layer1.threshold)
        family = cascade.layer2.classes[int(np.argmax(second[k]))] if r.is_malware else None
        assert r.family_id == family and r.family_name == {0: "emo", 1: "zeus"}.get(family)
    path = scratch_path(spark, "fitted-cascade")
    fc.save(spark, cascade, path)
    again = {r.sha256: r for r in fc.predict(fc.load(spark, path), rows).collect()}
    assert again == got
    report = fc.evaluate(cascade, rows).first()
    right = [got[r.sha256].family_id == r.y_fam and got[r.sha256].is_malware == 1 for r in rows.collect() if r.y_fam >= 0]
    assert report["end_to_end_family_accuracy"] == pytest.approx(np.mean(right)) and report["end_to_end_family_accuracy"] > 0.8


def test_only_flagged_rows_reach_layer_2(spark, rows):
    cascade = fc.fit_cascade(rows, ("logreg", {"maxIter": 30}), ("passive_aggressive", {"epochs": 2}))
    reached = spark.sparkContext.accumulator(0)
    inner = ml.scorer(cascade.layer2)

    def counted(df):
        def count(batches):
            for b in batches:
                reached.add(b.num_rows)
                yield b
        return inner(df.mapInArrow(count, df.schema))
    from sigspark.operators.cascade import cascade_predict
    flagged = cascade_predict(rows, ml.scorer(cascade.layer1), cascade.layer1.threshold, counted, None, cascade.classes).where("is_malware = 1").count()
    assert reached.value == flagged < 400


def test_cascade_without_families(spark, rows):
    benign = rows.withColumn("y_fam", F.lit(-1))
    cascade = fc.fit_cascade(benign, ("logreg", {"maxIter": 10}), ("passive_aggressive", {}))
    assert cascade.layer2 is None and fc.predict(cascade, rows).where("family_id is not null").count() == 0


def test_categorical_slots_reach_a_tree(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    odd = {1, 4, 6}
    data = [([float(i % 8), float(i % 5)], float(i % 8 in odd)) for i in range(400)]
    d = ml.with_categorical_vector(spark.createDataFrame(data, "features array<double>, label double"), 2, {0: 8, 701: 36}, names={0: "byte"})
    assert [tuple(r) for r in ml.read_slots(d).collect()] == [(0, "byte", 8)]
    tree = DecisionTreeClassifier(featuresCol="fv", maxDepth=1, maxBins=8).fit(d)
    assert "in {1.0,4.0,6.0}" in tree.toDebugString or "in {0.0,2.0,3.0,5.0,7.0}" in tree.toDebugString
    assert tree.transform(d).where("prediction != label").count() == 0                        # one split of a set, no order needed
    wrong = ml.with_categorical_vector(spark.createDataFrame([([9.0, 1.0],), ([-1.0, 1.0],), ([1.5, 1.0],)], "features array<double>"), 2, {0: 8})
    assert {r.fv[0] for r in wrong.collect()} == {7.0}


def test_tuning_in_threads_equals_a_serial_run(spark, rows):
    data = rows.withColumn("y", F.col("y_bin")).withColumn("at", F.col("sha256").cast("int"))
    grid = [{"maxIter": 5, "regParam": r} for r in (0.5, 0.001)]
    table, model = ml.tune_and_refit(data, ["at"], grid, "logreg", 2, parallelism=3)
    got = {(r.grid_id, r.fold): r.partial_auc for r in table.collect()}
    serial = {(r.grid_id, r.fold): r.partial_auc for r in ml.tune_grid(data, ["at"], grid, "logreg", 2).collect()}
    assert got == pytest.approx(serial)
    best = {r.grid_id for r in table.collect() if r.best}
    assert len(best) == 1 and model.params == grid[best.pop()] and model.validation_f1 is not None
