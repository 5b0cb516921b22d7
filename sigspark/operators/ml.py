"""Model training, scoring and persistence with MLlib.

``train_classifier`` is the DataFrame version of the reference's training
entry point: labeled-row filter -> optional exact stratified sample ->
stratified train/validation split -> class weights as a weight column ->
MLlib ``Pipeline.fit`` (distributed) -> decision threshold = best validation
F1 (binary). All of it runs on executors; only model parameters reach the
driver. Learners take the reference's slots: logistic regression (scaled,
no centring), random forest, multilayer perceptron, boosted trees (one-vs-rest
for many classes), linear SVM, ridge (least squares on +-1 targets).
"""
from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from . import metrics as mt
from . import splits as sp
from .joins import attach_weight

MODEL_TYPES = ["logreg", "rf", "mlp", "gbt", "linear_svm", "ridge", "stream_linear", "passive_aggressive"]
#: Slots trained in passes over the rows; their model is a ``LinearModel``.
PASS_TYPES = ("stream_linear", "passive_aggressive")


@dataclass
class TrainedModel:
    model: "PipelineModel | LinearModel"
    model_type: str
    problem_type: str
    threshold: float = 0.5
    validation_f1: float | None = None
    classes: list[int] = field(default_factory=list)
    params: dict = field(default_factory=dict)


def with_vector(df: DataFrame, features: str = "features", out: str = "fv") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features)))


def categorical_slots(width: int, slots: dict[int, int], names: dict[int, str] | None = None) -> dict:
    """Metadata of a vector column (``ft_categorical_meta``): ``slots`` (place -> number of values) hold categories
    0, 1, ..., the others numbers. Tree learners then split those slots by sets of values."""
    named = lambda i: {"idx": i, "name": (names or {}).get(i, f"f{i}")}
    at = {i: n for i, n in slots.items() if i < width}
    return {"ml_attr": {"attrs": {"nominal": [{**named(i), "num_vals": n} for i, n in sorted(at.items())],
                                  "numeric": [named(i) for i in range(width) if i not in at]}, "num_attrs": width}}


def with_categorical_vector(df: DataFrame, width: int, slots: dict[int, int], features: str = "features", out: str = "fv",
                            names: dict[int, str] | None = None) -> DataFrame:
    """Adds the vector with its metadata. A value that is no category of its slot (not whole, below 0 or too great) becomes
    the last one, so tree learners accept every row."""
    at = {i: n for i, n in slots.items() if i < width}
    table = F.create_map(*[F.lit(x) for i, n in at.items() for x in (i, n)]) if at else None

    def fitted(x, i):
        n = F.try_element_at(table, i)
        whole = (x >= 0) & (x < n) & (x == F.floor(x))
        return F.when(n.isNull() | whole, x.cast("double")).otherwise((n - 1).cast("double"))

    values = F.transform(features, fitted) if at else F.col(features).cast("array<double>")
    return df.withColumn(out, array_to_vector(values)).withMetadata(out, categorical_slots(width, slots, names))


def read_slots(df: DataFrame, column: str = "fv") -> DataFrame:
    """(slot, name, n_values) of a vector column's categories, from its metadata."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    rows = [(int(a["idx"]), a.get("name"), int(a["num_vals"])) for a in attrs]
    return df.sparkSession.createDataFrame(rows, "slot int, name string, n_values int")


def _estimator(model_type: str, problem_type: str, n_features: int, n_classes: int, params: dict,
               weighted: bool, n_rows: int = 0):
    p = dict(params or {})
    # one unit of squared weight against the summed loss, as a mean over the rows
    l2 = p.get("regParam", 1.0 / max(1, n_rows))
    wc = {"weightCol": "weight"} if weighted else {}
    if model_type == "logreg":
        return [StandardScaler(inputCol="fv", outputCol="fs", withMean=False, withStd=True),
                LogisticRegression(featuresCol="fs", labelCol="label", maxIter=p.get("maxIter", 100),
                                   regParam=l2, **wc)]
    if model_type == "rf":
        return [RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=p.get("numTrees", 300),
                                       maxDepth=p.get("maxDepth", 10), seed=p.get("seed", 42), **wc)]
    if model_type == "mlp":
        layers = [n_features] + list(p.get("hidden", [512, 256, 128])) + [max(2, n_classes)]
        return [StandardScaler(inputCol="fv", outputCol="fs", withMean=False, withStd=True),
                MultilayerPerceptronClassifier(featuresCol="fs", labelCol="label", layers=layers,
                                               maxIter=p.get("maxIter", 100), seed=p.get("seed", 42))]
    if model_type == "gbt":
        gbt = GBTClassifier(featuresCol="fv", labelCol="label", maxIter=p.get("maxIter", 50),
                            maxDepth=p.get("maxDepth", 5), maxBins=p.get("maxBins", 32), seed=p.get("seed", 42),
                            **({"validationIndicatorCol": "is_val_flag"} if p.get("early_stopping") else {}), **wc)
        return [gbt] if problem_type == "binary" else [OneVsRest(classifier=gbt, featuresCol="fv", labelCol="label")]
    if model_type == "linear_svm":
        svm = LinearSVC(featuresCol="fs", labelCol="label", maxIter=p.get("maxIter", 100), regParam=l2, **wc)
        scaler = StandardScaler(inputCol="fv", outputCol="fs", withMean=False, withStd=True)
        return [scaler, svm] if problem_type == "binary" else [scaler, OneVsRest(classifier=svm, featuresCol="fs", labelCol="label")]
    if model_type == "ridge":
        if problem_type != "binary":
            raise ValueError("ridge slot is binary only")
        return [StandardScaler(inputCol="fv", outputCol="fs", withMean=False, withStd=True),
                LinearRegression(featuresCol="fs", labelCol="pm1", regParam=p.get("regParam", 1.0), elasticNetParam=0.0,
                                 predictionCol="decision", **wc)]
    raise ValueError(f"unknown model type {model_type!r}")


def _fit_frame(df: DataFrame, y: str, features: str) -> DataFrame:
    d = with_vector(df, features).withColumn("label", F.col(y).cast("double"))
    return d.withColumn("pm1", F.when(F.col(y) == 1, 1.0).otherwise(-1.0))


def scores_of(model: TrainedModel, df: DataFrame, features: str = "features") -> DataFrame:
    """``ml_scores``: adds ``score`` (binary: positive-class probability or decision
    value) or ``scores`` (multiclass: class probability array in ``classes`` order)."""
    if isinstance(model.model, LinearModel):
        out = stream_linear_scores(model.model, df, features)
        if model.problem_type != "binary":
            return out
        # the class with the greater number is the positive one; a model of one class is certain of it
        positive = F.try_element_at("scores", F.lit(2)) if len(model.model.classes) > 1 else F.lit(float(model.model.classes == [1]))
        return out.withColumn("score", positive).drop("scores")
    d = with_vector(df.drop("fv") if "fv" in df.columns else df, features)
    out = model.model.transform(d)
    if model.problem_type == "binary":
        if model.model_type == "ridge":
            return out.withColumn("score", F.col("decision"))
        if model.model_type == "linear_svm":
            return out.withColumn("score", vector_to_array("rawPrediction")[1])
        return out.withColumn("score", vector_to_array("probability")[1])
    col = "probability" if model.model_type in ("logreg", "rf", "mlp") else "rawPrediction"
    arr = vector_to_array(col)
    return out.withColumn("scores", F.slice(arr, 1, len(model.classes)) if model.classes else arr)


def predict_labels(model: TrainedModel, scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """``prj_threshold`` / ``prj_argmax_class`` on model scores."""
    if model.problem_type == "binary":
        t = model.threshold if threshold is None else threshold
        return scored.withColumn("pred", (F.col("score") >= t).cast("int"))
    return scored.withColumn("pred", mt.argmax_class(F.col("scores"), F.array(*[F.lit(c) for c in model.classes])))


def scorer(model: TrainedModel, out: str = "malware_score", features: str = "features"):
    """Cascade scorer: DataFrame -> DataFrame with ``out`` (binary score) or
    ``family_scores`` (multiclass)."""
    def f(df):
        s = scores_of(model, df, features)
        keep = [c for c in df.columns]
        if model.problem_type == "binary":
            return s.select(*keep, F.col("score").alias(out))
        return s.select(*keep, F.col("scores").alias("family_scores"))
    return f


def without_summary(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The model as it is read back from storage, without the training summary.

    A summary holds the session and the training frame; once the session has used an ``Observation`` it cannot be
    sent to tasks any more, and a model that carries it neither.
    """
    if not any(getattr(stage, "hasSummary", False) for stage in model.stages):
        return model
    path = scratch_path(spark, f"fitted-{uuid.uuid4().hex}")
    model.write().save(path)
    return PipelineModel.load(path)


def train_classifier(df: DataFrame, model_type: str, params: dict | None = None, problem_type: str | None = None,
                     validation_size: float = 0.1, seed: int = 42, sample_size: int | None = None,
                     class_weight_mode: str | None = None, class_weight_max: float = 20.0,
                     y: str = "y", key: str = "sha256", features: str = "features") -> TrainedModel:
    """``ml_train_classifier``."""
    lab = df.where(F.col(y) != -1)
    stats = lab.agg(F.count("*").alias("n"), F.countDistinct(y).alias("k"),
                    F.first(F.size(features)).alias("d")).first()
    if not stats["n"]:
        raise ValueError("every training row is unlabelled")
    k, d = int(stats["k"]), int(stats["d"])
    problem_type = problem_type or ("binary" if k <= 2 else "multiclass")
    lab = sp.stratified_sample(lab, y, key, sample_size, seed)
    split = sp.train_val_split(lab, y, key, validation_size, seed)
    weighted = False
    if class_weight_mode:
        w = sp.class_weights(split.where(~F.col("is_val")), y, class_weight_mode, class_weight_max)
        if w is not None:
            split = attach_weight(split, y, w.withColumnRenamed(y, "y") if y != "y" else w)
            weighted = True
    split = materialise(split, "training-split")           # fit, threshold search and class list reuse it
    classes = sorted(int(r[0]) for r in split.select(y).distinct().collect())   # bounded by the class count
    frame = _fit_frame(split, y, features).withColumn("is_val_flag", F.col("is_val"))
    n_cls = max(classes) + 1 if classes else 2
    if model_type in PASS_TYPES:
        fit = train_stream_linear if model_type == "stream_linear" else train_passive_aggressive
        rows = split.where(~F.col("is_val")).withColumnRenamed(y, "__y").drop("weight")
        pm = fit(rows, y="__y", features=features, key=key, seed=seed, class_weight_mode=class_weight_mode,
                 class_weight_max=class_weight_max, **(params or {}))
        known = pm.classes
    else:
        stages = _estimator(model_type, problem_type, d, n_cls, params or {}, weighted, int(stats["n"]))
        train = frame if (params or {}).get("early_stopping") else frame.where(~F.col("is_val"))
        pm = without_summary(df.sparkSession, Pipeline(stages=stages).fit(train))
        known = list(range(n_cls))
    tm = TrainedModel(pm, model_type, problem_type, classes=known if problem_type != "binary" else [0, 1],
                      params=dict(params or {}))
    if problem_type == "binary":
        val = frame.where(F.col("is_val"))
        if val.limit(1).count():
            s = scores_of(tm, val.drop("fv"), features).select(F.col(y).alias("y"), "score")
            best = mt.best_f1_threshold(s, "y", "score").first()
            tm.threshold, tm.validation_f1 = float(best["threshold"]), float(best["f1"])
    return tm


def evaluate(model: TrainedModel, df: DataFrame, y: str = "y", threshold: float | None = None,
             features: str = "features") -> DataFrame:
    """``met_binary_report`` / ``met_multiclass_report`` for a trained model; the rows are scored once and written."""
    s = scores_of(model, df, features)
    s = materialise(s.select(F.col(y).alias("y"), "score" if model.problem_type == "binary" else "scores"), "eval-scores")
    if model.problem_type == "binary":
        return mt.binary_report(s, model.threshold if threshold is None else threshold,
                                validation_threshold=model.threshold, validation_f1=model.validation_f1)
    cls = F.array(*[F.lit(c) for c in model.classes])
    return mt.multiclass_report(s.select("y", "scores", cls.alias("classes")))


# ---- persistence ---------------------------------------------------------------------------

def save_model(spark: SparkSession, model: TrainedModel, path: str) -> None:
    """``io_model``: PipelineModel plus a one-row metadata table."""
    if isinstance(model.model, LinearModel):
        save_linear(spark, model.model, os.path.join(path, "linear"))
    else:
        model.model.write().overwrite().save(os.path.join(path, "model"))
    meta = [(model.model_type, model.problem_type, float(model.threshold),
             None if model.validation_f1 is None else float(model.validation_f1), json.dumps(model.classes),
             json.dumps(model.params))]
    spark.createDataFrame(meta, "model_type string, problem_type string, threshold double, validation_f1 double, "
                                "classes string, params string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    m = spark.read.parquet(os.path.join(path, "meta")).first()
    fitted = load_linear(spark, os.path.join(path, "linear")) if m["model_type"] in PASS_TYPES else PipelineModel.load(os.path.join(path, "model"))
    return TrainedModel(fitted, m["model_type"], m["problem_type"],
                        m["threshold"], m["validation_f1"], json.loads(m["classes"]), json.loads(m["params"]))


def save_model_list(spark: SparkSession, models: list[tuple[int, TrainedModel]], path: str, prefix: str = "ovr") -> None:
    """``io_model_list``: one directory per model and a manifest keeping the label column index."""
    for j, m in models:
        save_model(spark, m, os.path.join(path, f"{prefix}_{j}"))
    spark.createDataFrame([(j, f"{prefix}_{j}") for j, _ in models], "label_index int, name string") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(path, f"{prefix}_manifest"))


def load_model_list(spark: SparkSession, path: str, prefix: str = "ovr") -> list[tuple[int, TrainedModel]]:
    man = spark.read.json(os.path.join(path, f"{prefix}_manifest")).orderBy("label_index").collect()
    return [(int(r["label_index"]), load_model(spark, os.path.join(path, r["name"]))) for r in man]


# ---- multilabel, scaler, tuning, benchmark --------------------------------------------------

def train_multilabel_ovr(df: DataFrame, model_type: str = "logreg", params: dict | None = None,
                         validation_size: float = 0.1, seed: int = 42, y: str = "y_multi", key: str = "sha256",
                         features: str = "features") -> list[tuple[int, TrainedModel]]:
    """``ml_multilabel_ovr``: one binary model per label column (single-valued columns
    skipped), keeping the column index."""
    lab = df.where(F.aggregate(F.col(y), F.lit(0), lambda a, x: a + x) > 0).cache()
    width = lab.select(F.max(F.size(y))).first()[0] or 0
    out = []
    ends = lab.agg(*[f(F.get(y, F.lit(j))).alias(f"{n}{j}") for j in range(width) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for j in range(width):
        if ends[f"lo{j}"] == ends[f"hi{j}"]:
            continue
        d = lab.withColumn("__yj", F.col(y)[j])
        out.append((j, train_classifier(d, model_type, params, "binary", validation_size, seed, y="__yj", key=key,
                                        features=features)))
    lab.unpersist()
    return out


def scaler_pass(df: DataFrame, features: str = "features") -> DataFrame:
    """``ml_scaler_pass``: population std per feature (no centring), one distributed pass."""
    v = with_vector(df, features)
    r = v.select(Summarizer.metrics("variance", "count").summary(F.col("fv")).alias("s")).first()["s"]
    n = float(r["count"])
    var = r["variance"].toArray()
    scale = (n - 1) / n if n > 1 else 0.0
    spark = df.sparkSession
    return spark.createDataFrame([(i, float((x * scale) ** 0.5)) for i, x in enumerate(var)], "feature int, std double")


def tune_grid(df: DataFrame, order_cols: list[str], grid: list[dict], model_type: str = "gbt", n_splits: int = 3,
              y: str = "y", key: str = "sha256", features: str = "features") -> DataFrame:
    """``ml_tune_grid``: expanding-window time folds x parameter grid, scored by the
    partial ROC AUC (FPR <= 0.005) on each fold's test rows."""
    folds = sp.time_series_folds(df, order_cols, n_splits).cache()
    rows = []
    for gi, params in enumerate(grid):
        for f in range(n_splits):
            tr = folds.where((F.col("fold") == f) & (F.col("role") == "train"))
            te = folds.where((F.col("fold") == f) & (F.col("role") == "test"))
            m = train_classifier(tr, model_type, params, "binary", validation_size=0.0, y=y, key=key, features=features)
            s = scores_of(m, te, features).select(F.col(y).alias("y"), "score")
            pauc = mt.binary_curve_metrics(s).first()["partial_auc"]
            rows.append((gi, json.dumps(params, sort_keys=True), f, float(pauc)))
    folds.unpersist()
    return df.sparkSession.createDataFrame(rows, "grid_id int, params string, fold int, partial_auc double")


def tune_and_refit(df: DataFrame, order_cols: list[str], grid: list[dict], model_type: str = "gbt", n_splits: int = 3,
                   y: str = "y", key: str = "sha256", features: str = "features", parallelism: int = 4) -> tuple[DataFrame, TrainedModel]:
    """``ml_tune_grid`` as one job: (fold scores of every grid point with their mean and the best one marked, the model
    refitted with the best parameters on all rows).

    The folds are written once. Up to ``parallelism`` fits run at a time, each from a thread of its own, so that the
    cluster is not idle in the narrow ends of one fit; scores do not depend on it. Ties go to the first grid point.
    """
    folds = materialise(sp.time_series_folds(df, order_cols, n_splits), "tuning-folds")

    def one(job):
        point, fold = job
        train, test = (folds.where((F.col("fold") == fold) & (F.col("role") == role)) for role in ("train", "test"))
        model = train_classifier(train, model_type, grid[point], "binary", validation_size=0.0, y=y, key=key, features=features)
        scored = scores_of(model, test, features).select(F.col(y).alias("y"), "score")
        return point, fold, float(mt.binary_curve_metrics(scored).first()["partial_auc"])

    with ThreadPool(max(1, parallelism)) as pool:
        found = pool.map(one, [(g, f) for g in range(len(grid)) for f in range(n_splits)], chunksize=1)
    mean = {g: sum(s for p, _, s in found if p == g) / n_splits for g in range(len(grid))}
    best = max(mean, key=lambda g: (mean[g], -g))
    rows = [(g, json.dumps(grid[g], sort_keys=True), f, s, mean[g], g == best) for g, f, s in sorted(found)]
    table = df.sparkSession.createDataFrame(rows, "grid_id int, params string, fold int, partial_auc double, mean_partial_auc double, best boolean")
    return table, train_classifier(df, model_type, grid[best], "binary", validation_size=0.1, y=y, key=key, features=features)


def benchmark(train: DataFrame, test: DataFrame, specs: list[tuple[str, dict]], y: str = "y",
              key: str = "sha256", features: str = "features") -> DataFrame:
    """``ml_benchmark``: fit + evaluate each (model_type, params); one row per model
    with elapsed seconds and the main metric."""
    rows = []
    for model_type, params in specs:
        t0 = time.perf_counter()
        m = train_classifier(train, model_type, params, y=y, key=key, features=features)
        fit_s = time.perf_counter() - t0
        rep = evaluate(m, test, y, features=features).first().asDict()
        metric = rep.get("roc_auc", rep.get("accuracy"))
        rows.append((model_type, json.dumps(params, sort_keys=True), m.problem_type, float(fit_s),
                     float(time.perf_counter() - t0), None if metric is None else float(metric)))
    return train.sparkSession.createDataFrame(
        rows, "model_type string, params string, problem_type string, fit_seconds double, total_seconds double, metric double")


# ---- mini-batch linear trainer (stream_linear) ------------------------------------------------

@dataclass
class LinearModel:
    weights: "object"          # numpy (K, D + 1): last column is the bias
    classes: list[int]
    scale: "object"            # numpy (D,): 1 / population std (1 where std is 0)


def save_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    """One row for each class, and one (without a class) for the scales."""
    rows = [(int(c), [float(v) for v in w]) for c, w in zip(model.classes, model.weights)]
    rows.append((None, [float(v) for v in model.scale]))
    spark.createDataFrame(rows, "class int, weights array<double>").write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    rows = {r["class"]: np.array(r["weights"]) for r in spark.read.parquet(path).collect()}      # one row for each class
    scale = rows.pop(None)
    classes = sorted(rows)
    return LinearModel(np.array([rows[c] for c in classes]).reshape(len(classes), len(scale) + 1), classes, scale)


def train_stream_linear(df: DataFrame, y: str = "y", features: str = "features", epochs: int = 4,
                        chunk_size: int = 8192, lr: float = 0.5, class_weight_mode: str | None = "balanced_sqrt",
                        class_weight_max: float = 20.0, seed: int = 42, key: str = "sha256") -> LinearModel:
    """``ml_stream_linear``: multinomial logistic regression by mini-batch SGD.

    One population-std scaler pass, then per epoch: rows are re-shuffled by a
    hash of (seed, epoch, key) (one shuffle), every partition runs SGD over its
    rows in chunks starting from the broadcast weights, and the partition
    weights are averaged by a distributed weighted mean (iterative parameter
    mixing). Only the K x D weight matrix and the D scales reach the driver.
    """
    spark = df.sparkSession
    lab = df.where(F.col(y) != -1).select(key, F.col(y).cast("int").alias("y"), F.col(features).alias("x"))
    classes = sorted(int(r[0]) for r in lab.select("y").distinct().collect())
    k_index = {c: i for i, c in enumerate(classes)}
    std = np.array([r["std"] for r in scaler_pass(lab.withColumnRenamed("x", "features")).orderBy("feature").collect()])
    scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 1.0)
    cw = sp.class_weights(lab, "y", class_weight_mode, class_weight_max)
    wmap = {int(r["y"]): float(r["weight"]) for r in cw.collect()} if cw is not None else {}
    K, D = len(classes), len(scale)
    W = np.zeros((K, D + 1))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(1, max(1, epochs) + 1):
        bW = spark.sparkContext.broadcast(W)
        bS = spark.sparkContext.broadcast((scale, k_index, wmap, chunk_size, lr))

        def fit_partition(it):
            W0 = bW.value.copy()
            sc_, kidx, wm, chunk, rate = bS.value
            n = 0
            for pdf in it:
                if len(pdf) == 0:
                    continue
                X = np.vstack(pdf["x"].to_numpy()).astype(np.float64) * sc_
                Xb = np.hstack([X, np.ones((len(X), 1))])
                yi = np.array([kidx[v] for v in pdf["y"]])
                sw = np.array([wm.get(int(v), 1.0) for v in pdf["y"]])
                for s in range(0, len(Xb), chunk):
                    xb, ybt, wb = Xb[s:s + chunk], yi[s:s + chunk], sw[s:s + chunk]
                    z = xb @ W0.T
                    z -= z.max(axis=1, keepdims=True)
                    p = np.exp(z)
                    p /= p.sum(axis=1, keepdims=True)
                    p[np.arange(len(ybt)), ybt] -= 1.0
                    W0 -= rate * ((p * wb[:, None]).T @ xb) / max(len(xb), 1)
                n += len(pdf)
            if n:
                yield pd.DataFrame({"w": [W0.ravel().tolist()], "n": [float(n)]})

        shuffled = (lab.withColumn("__k", sp.order_key(f"{seed}|{epoch}", key))
                       .repartition(n_parts, "__k").sortWithinPartitions("__k").select("y", "x"))
        parts = shuffled.mapInPandas(fit_partition, "w array<double>, n double")
        mean = parts.select(Summarizer.mean(array_to_vector("w"), F.col("n")).alias("m")).first()["m"]
        W = np.asarray(mean.toArray()).reshape(K, D + 1)
        bW.unpersist()
        bS.unpersist()
    return LinearModel(W, classes, scale)


def passive_aggressive_pass(weights: np.ndarray, x: np.ndarray, y: np.ndarray, rate: np.ndarray, total: np.ndarray) -> None:
    """One pass of multiclass passive-aggressive steps, in place; ``total`` gathers the weights after every row.

    A row whose own class does not lead its strongest rival by a margin of 1 moves both classes' weights
    by the smallest step that restores the margin, at most ``rate`` (the aggressiveness times the row's weight).
    """
    for row, own, most in zip(x, y, rate):
        margin = weights @ row
        ahead = margin[own]
        margin[own] = -np.inf
        rival = int(margin.argmax())
        loss = 1.0 - ahead + margin[rival]
        if loss > 0:
            step = min(most, loss / (2.0 * float(row @ row)))
            weights[own] += step * row
            weights[rival] -= step * row
        total += weights


def train_passive_aggressive(df: DataFrame, y: str = "y", features: str = "features", epochs: int = 4,
                             aggressiveness: float = 0.1, class_weight_mode: str | None = "balanced_sqrt",
                             class_weight_max: float = 20.0, seed: int = 42, key: str = "sha256",
                             parts: int | None = None) -> LinearModel:
    """The passive-aggressive slot of ``ml_stream_linear``: scaled rows with a bias, closed-form margin steps, averaged weights.

    Per epoch the rows are dealt anew by a hash of (seed, epoch, key) to ``parts`` partitions; each starts from the last
    epoch's mean weights and returns its final weights and their average over its rows. Spark means both over the
    partitions by their rows. The model is the average of all epochs. Rows of the same key lie together; a single
    class has no rival, so its weights stay 0. Null labels are left out, and so are those of -1.
    """
    spark = df.sparkSession
    lab = df.where(F.col(y) != -1).select(key, F.col(y).cast("int").alias("y"), F.col(features).alias("x"))
    classes = sorted(int(r[0]) for r in lab.select("y").distinct().collect())
    place = {c: i for i, c in enumerate(classes)}
    std = np.array([r["std"] for r in scaler_pass(lab.withColumnRenamed("x", "features")).orderBy("feature").collect()])
    scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 1.0)
    cw = sp.class_weights(lab, "y", class_weight_mode, class_weight_max)
    rate = {int(r["y"]): aggressiveness * float(r["weight"]) for r in cw.collect()} if cw is not None else {}
    k, d = len(classes), len(scale)
    weights, mean = np.zeros((k, d + 1)), np.zeros((k, d + 1))
    if k < 2:
        return LinearModel(mean, classes, scale)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast((weights, scale, place, rate))       # classes x features

        def one(batches):
            w, by, at, rates = shared.value
            w, total, n = w.copy(), np.zeros_like(w), 0
            for pdf in batches:
                if len(pdf):
                    x = np.vstack(pdf["x"].to_numpy()).astype(np.float64) * by
                    x = np.hstack([x, np.ones((len(x), 1))])
                    passive_aggressive_pass(w, x, np.array([at[v] for v in pdf["y"]]),
                                            np.array([rates.get(int(v), aggressiveness) for v in pdf["y"]]), total)
                    n += len(pdf)
            if n:
                yield pd.DataFrame({"w": [w.ravel().tolist()], "m": [(total / n).ravel().tolist()], "n": [float(n)]})

        dealt = (lab.withColumn("__k", sp.order_key(f"{seed}|{epoch}", key))
                    .repartition(parts, "__k").sortWithinPartitions("__k", "y").select("y", "x"))
        got = dealt.mapInPandas(one, "w array<double>, m array<double>, n double").select(
            Summarizer.mean(array_to_vector("w"), F.col("n")).alias("w"), Summarizer.mean(array_to_vector("m"), F.col("n")).alias("m")).first()
        weights = np.asarray(got["w"].toArray()).reshape(k, d + 1)
        mean += np.asarray(got["m"].toArray()).reshape(k, d + 1) / epochs
        shared.unpersist()
    return LinearModel(mean, classes, scale)


def stream_linear_scores(model: LinearModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Class probabilities (``scores``) with the weights broadcast to an Arrow UDF."""
    from pyspark.sql import types as T
    b = df.sparkSession.sparkContext.broadcast((model.weights, model.scale))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _score(x: pd.Series) -> pd.Series:
        W, sc_ = b.value
        X = np.vstack(x.to_numpy()).astype(np.float64) * sc_
        z = np.hstack([X, np.ones((len(X), 1))]) @ W.T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return pd.Series(list(p))

    return df.withColumn("scores", _score(F.col(features)))


def evaluate_stream_linear(model: LinearModel, df: DataFrame, y: str = "y", features: str = "features") -> DataFrame:
    s = stream_linear_scores(model, df, features)
    cls = F.array(*[F.lit(c) for c in model.classes])
    return mt.multiclass_report(s.select(F.col(y).alias("y"), "scores", cls.alias("classes")))
