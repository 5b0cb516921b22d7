"""Registered MLlib, model-IO, sink and scan queries.

Training data: ``embeddings`` (64-wide float vectors), binary y = label >= 5,
multiclass y = label; train / test by a hash split on vec_id. The scan runs
on ``documents`` as a file corpus (bytes = UTF-8 text, path from source,
doc_id and a language-dependent suffix) with formula scores, so its result
has a SQL oracle; learned models are checked rows-only.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as fb
from ..operators import cascade as cs
from ..operators import labels as lb
from ..operators import ml
from ..operators import splits as sp
from ..session import materialise, scratch_path
from ..sources import corpus as cp
from ..sources.tables import table


def emb(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    d = e.select(F.col("vec_id").cast("string").alias("sha256"), "vec_id", F.col("embedding").alias("features"),
                 (F.col("label") >= 5).cast("int").alias("y_bin"), F.col("label").alias("y_cls"))
    s = sp.stratified_split(d, "y_cls", "vec_id", 0.3, seed=11)
    return s


def _train_test(spark, sf, y):
    s = emb(spark, sf).withColumn("y", F.col(y))
    return s.where(~F.col("is_val")).drop("is_val"), s.where(F.col("is_val")).drop("is_val")


def _binary_model_query(model_type, params):
    def q(spark, sf):
        tr, te = _train_test(spark, sf, "y_bin")
        m = ml.train_classifier(tr, model_type, params, "binary", validation_size=0.2, seed=5)
        return ml.evaluate(m, te).select("roc_auc", "pr_auc", "accuracy", "f1", "threshold")
    return q


def q_ml_train_classifier(spark, sf):
    tr, te = _train_test(spark, sf, "y_cls")
    m = ml.train_classifier(tr, "logreg", {"maxIter": 50}, None, validation_size=0.1, seed=5,
                            class_weight_mode="balanced_sqrt")
    return ml.evaluate(m, te)


def q_ml_scores(spark, sf):
    tr, te = _train_test(spark, sf, "y_bin")
    m = ml.train_classifier(tr, "logreg", {"maxIter": 50}, "binary", seed=5)
    return ml.predict_labels(m, ml.scores_of(m, te)).select("vec_id", "score", "pred")


def q_ml_multilabel_ovr(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select(F.col("vec_id").cast("string").alias("sha256"), F.col("embedding").alias("features"),
                 F.array((F.col("label") >= 5).cast("int"), (F.col("label") % 2 == 0).cast("int"),
                         F.lit(0)).alias("y_multi"))
    models = ml.train_multilabel_ovr(d, "logreg", {"maxIter": 30})
    from ..operators.metrics import multilabel_report
    scored = d
    for j, m in models:
        scored = ml.scores_of(m, scored).withColumnRenamed("score", f"s{j}").drop("fv", "fs", "rawPrediction",
                                                                                  "probability", "prediction")
    scores = F.array(*[F.col(f"s{j}") if any(j == k for k, _ in models) else F.lit(0.0) for j in range(3)])
    rep = multilabel_report(scored.select(F.col("y_multi").alias("y"), scores.alias("scores")), threshold=0.5)
    return rep.withColumn("n_models", F.lit(len(models))).withColumn(
        "label_indices", F.lit(",".join(str(j) for j, _ in models)))


def q_ml_scaler_pass(spark, sf):
    return ml.scaler_pass(table(spark, sf, "embeddings").select(F.col("embedding").alias("features"))) \
        .select("feature", F.round("std", 6).alias("std"))


def q_ml_tune_grid(spark, sf):
    e = emb(spark, sf).withColumn("y", F.col("y_bin"))
    grid = [{"maxIter": 20, "regParam": 0.0}, {"maxIter": 20, "regParam": 0.1}]
    return ml.tune_grid(e, ["vec_id"], grid, "logreg", 3)


def q_ml_benchmark(spark, sf):
    tr, te = _train_test(spark, sf, "y_bin")
    return ml.benchmark(tr, te, [("logreg", {"maxIter": 30}), ("rf", {"numTrees": 10, "maxDepth": 5})])


def q_ml_stream_linear(spark, sf):
    tr, te = _train_test(spark, sf, "y_cls")
    m = ml.train_stream_linear(tr, "y", epochs=3, chunk_size=64, seed=42)
    return ml.evaluate_stream_linear(m, te, "y")


def q_io_model(spark, sf):
    tr, te = _train_test(spark, sf, "y_bin")
    m = ml.train_classifier(tr, "logreg", {"maxIter": 30}, "binary", seed=5)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    ml.save_model(spark, m, path)
    m2 = ml.load_model(spark, path)
    a = ml.scores_of(m, te).select("vec_id", F.col("score").alias("a"))
    b = ml.scores_of(m2, te).select("vec_id", F.col("score").alias("b"))
    return a.join(b, "vec_id").select("vec_id", (F.abs(F.col("a") - F.col("b")) < 1e-12).alias("same"),
                                      F.lit(m2.threshold).alias("threshold"))


def q_io_model_list(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select(F.col("vec_id").cast("string").alias("sha256"), F.col("embedding").alias("features"),
                 F.array((F.col("label") >= 5).cast("int"), F.lit(0), (F.col("label") % 2 == 0).cast("int")).alias("y_multi"))
    models = ml.train_multilabel_ovr(d, "logreg", {"maxIter": 20})
    path = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    ml.save_model_list(spark, models, path)
    back = ml.load_model_list(spark, path)
    return spark.createDataFrame([(j, m.model_type, m.problem_type) for j, m in back],
                                 "label_index int, model_type string, problem_type string")


def q_io_label_map(spark, sf):
    d = table(spark, sf, "documents")
    m = lb.build_label_map(d, "source", class_min=1)
    path = scratch_path(spark, f"label-map-{uuid.uuid4().hex}")
    m.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("label string, id int, n bigint").json(path)


def q_sink_vectors(spark, sf):
    """Write (sha256, subset, features, label) partitioned by subset; read back counts."""
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").cast("string").alias("sha256"), F.col("embedding").alias("features"),
                 (F.col("label") >= 5).cast("int").alias("label"),
                 F.when(F.col("label") < 7, "train").otherwise("test").alias("subset"))
    path = scratch_path(spark, f"vectors-{uuid.uuid4().hex}")
    v.write.mode("overwrite").partitionBy("subset").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("subset").agg(F.count("*").alias("n"), F.min(F.size("features")).alias("dim"))


def q_src_vectors(spark, sf):
    """``src_vectors``: read vectors with the width check (rows of another width are an error)."""
    e = table(spark, sf, "embeddings")
    bad = e.where(F.size("embedding") != 64).limit(1).count()
    if bad:
        raise ValueError("feature width mismatch")
    return e.agg(F.count("*").alias("n_rows"), F.min(F.size("embedding")).alias("dim"))


def q_sink_project_layout(spark, sf):
    """One feature table plus label-only tables (binary, family) joined by key in a view."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y_bin"))
    m = lb.build_label_map(d, "source", 10)
    fam = lb.encode_single_label(d, "source", m, out="y_fam").select("doc_id", "y_fam")
    view = d.join(lab, "doc_id", "left").join(fam, "doc_id", "left")
    return view.groupBy(F.col("y_bin")).agg(F.count("*").alias("n"), F.countDistinct("y_fam").alias("n_families"))


def q_sink_report_json(spark, sf):
    from ..operators.metrics import binary_curve_metrics
    from .metrics_q import binary
    rep = binary_curve_metrics(binary(spark, sf))
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    rep.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.json(path).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


# ---- corpus scan with formula scores -----------------------------------------------------------

EXT = "CASE lang WHEN 'en' THEN '.exe' WHEN 'fr' THEN '.DLL' WHEN 'de' THEN '.txt' ELSE '.Sys' END"


def corpus_files(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                             F.expr(EXT)).alias("path"),
                    F.octet_length(F.encode("text", "UTF-8")).cast("bigint").alias("length"),
                    F.encode("text", "UTF-8").alias("content"))


def _scan(spark, sf):
    ok, err = cp.select_corpus(corpus_files(spark, sf), cp.DEFAULT_EXECUTABLE_EXTENSIONS)
    feats = (ok.withColumn("hist", fb.byte_histogram_udf(F.col("content")))
               .select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"),
                       (fb.is_pe_guess(F.col("content")) == 1).alias("is_pe"),
                       fb.entropy_from_counts(F.col("hist")).alias("entropy"), "hist"))

    def layer1(df):
        return df.withColumn("malware_score", F.col("entropy") / 8.0)

    def layer2(df):
        tot = F.aggregate("hist", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return df.withColumn("family_scores", F.array(*[(F.col("hist")[b] / tot) for b in (0x65, 0x20, 0x61, 0x74)]))

    fmap = lb.build_label_map(table(spark, sf, "documents"), "source", class_min=1)
    return cs.scan_results(feats, layer1, 0.55, layer2, fmap, F.sequence(F.lit(0), F.lit(3)), 3, 0.05, err)


def q_csc_scan(spark, sf):
    r = _scan(spark, sf)
    return r.select("path", "sha256", "size", "is_pe", "is_malware", F.round("malware_score", 6).alias("malware_score"),
                    "family", F.round("family_confidence", 6).alias("family_confidence"),
                    cs.top_families_text(F.col("top_families")).alias("top_families"), "error")


def q_src_corpus(spark, sf):
    ok, err = cp.select_corpus(corpus_files(spark, sf), cp.DEFAULT_EXECUTABLE_EXTENSIONS)
    files = ok.select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("error"))
    return files if err is None else files.unionByName(err)


def q_prj_verdict(spark, sf):
    return cs.verdict(_scan(spark, sf)).select("path", "verdict", F.round("malware_score", 6).alias("malware_score"), "family")


def q_agg_scan_summary(spark, sf):
    return cs.scan_summary(_scan(spark, sf))


def q_sink_scan_csv(spark, sf):
    """Write the scan as CSV (top families flattened) and read it back."""
    r = _scan(spark, sf)
    flat = r.select("path", "is_malware", "family", cs.top_families_text(F.col("top_families")).alias("top_families"), "error")
    path = scratch_path(spark, f"scan-{uuid.uuid4().hex}")
    flat.write.mode("overwrite").option("header", "true").csv(path)
    back = spark.read.option("header", "true").schema("path string, is_malware boolean, family string, top_families string, error string").csv(path)
    return back.select("path", "family", F.coalesce("top_families", F.lit("")).alias("top_families"))


QUERIES = {
    "ml_logreg": _binary_model_query("logreg", {"maxIter": 50}),
    "ml_random_forest": _binary_model_query("rf", {"numTrees": 20, "maxDepth": 5}),
    "ml_mlp": _binary_model_query("mlp", {"hidden": [32, 16], "maxIter": 50}),
    "ml_gbt": _binary_model_query("gbt", {"maxIter": 10, "maxDepth": 3}),
    "ml_linear_svm": _binary_model_query("linear_svm", {"maxIter": 50}),
    "ml_ridge": _binary_model_query("ridge", {"regParam": 1.0}),
    "ml_train_classifier": q_ml_train_classifier,
    "ml_scores": q_ml_scores,
    "ml_multilabel_ovr": q_ml_multilabel_ovr,
    "ml_scaler_pass": q_ml_scaler_pass,
    "ml_tune_grid": q_ml_tune_grid,
    "ml_benchmark": q_ml_benchmark,
    "ml_stream_linear": q_ml_stream_linear,
    "io_model": q_io_model,
    "io_model_list": q_io_model_list,
    "io_label_map": q_io_label_map,
    "sink_vectors": q_sink_vectors,
    "src_vectors": q_src_vectors,
    "sink_project_layout": q_sink_project_layout,
    "sink_report_json": q_sink_report_json,
    "csc_scan": q_csc_scan,
    "src_corpus": q_src_corpus,
    "prj_verdict": q_prj_verdict,
    "agg_scan_summary": q_agg_scan_summary,
    "sink_scan_csv": q_sink_scan_csv,
}

# ---- DuckDB oracles -------------------------------------------------------------------------------

SCAN = f"""
WITH f AS (SELECT doc_id, source, '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || ({EXT}) AS path,
                  octet_length(encode(text)) AS n, hex(encode(text)) AS h, sha256(text) AS sha FROM documents),
sel AS (SELECT * FROM f WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.exe', '.dll', '.sys', '.scr', '.ocx', '.com', '.cpl', '.drv', '.efi', '.msi')),
ok AS (SELECT * FROM sel),
bytes AS (SELECT doc_id, n, substr(h, 2*i+1, 2) AS byte FROM ok, range(n) t(i)),
hist AS (SELECT doc_id, n, byte, count(*) AS c FROM bytes GROUP BY ALL),
ent AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e,
               coalesce(max(CASE WHEN byte = '65' THEN c END), 0) / any_value(n) AS p0,
               coalesce(max(CASE WHEN byte = '20' THEN c END), 0) / any_value(n) AS p1,
               coalesce(max(CASE WHEN byte = '61' THEN c END), 0) / any_value(n) AS p2,
               coalesce(max(CASE WHEN byte = '74' THEN c END), 0) / any_value(n) AS p3 FROM hist GROUP BY doc_id),
lm AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS id
       FROM (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1)),
sc AS (SELECT ok.path, ok.sha, ok.n, e.e / 8.0 AS ms, [p0, p1, p2, p3] AS fs FROM ok JOIN ent e USING (doc_id)),
c AS (SELECT path, unnest(fs) AS score, unnest(range(0, 4)) AS cls FROM sc WHERE ms >= 0.55),
r AS (SELECT c.*, row_number() OVER (PARTITION BY path ORDER BY score DESC, cls ASC) AS rank,
             coalesce(lm.label, 'class_' || CAST(cls AS VARCHAR)) AS name FROM c LEFT JOIN lm ON c.cls = lm.id),
t AS (SELECT path, string_agg(printf('%s (%.3f)', name, score), '; ' ORDER BY rank) AS top_families,
             max(CASE WHEN rank = 1 THEN score END) AS best, max(CASE WHEN rank = 1 THEN name END) AS best_name
      FROM r WHERE rank <= 3 GROUP BY path),
res AS (
  SELECT sc.path, sc.sha AS sha256, sc.n AS size, false AS is_pe, sc.ms >= 0.55 AS is_malware, round(sc.ms, 6) AS malware_score,
         CASE WHEN sc.ms >= 0.55 THEN CASE WHEN t.best < 0.05 THEN 'unknown' ELSE t.best_name END END AS family,
         CASE WHEN sc.ms >= 0.55 THEN round(t.best, 6) END AS family_confidence,
         coalesce(t.top_families, '') AS top_families, CAST(NULL AS VARCHAR) AS error, sc.ms AS ms_raw
  FROM sc LEFT JOIN t USING (path))
"""

ORACLE = {
    "ml_scaler_pass": """
WITH u AS (SELECT unnest(embedding) AS x, unnest(range(0, 64)) AS feature FROM embeddings)
SELECT CAST(feature AS INTEGER) AS feature, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std FROM u GROUP BY feature""",
    "sink_vectors": """
SELECT CASE WHEN label < 7 THEN 'train' ELSE 'test' END AS subset, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dim
FROM embeddings GROUP BY 1""",
    "src_vectors": "SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings",
    "io_label_map": """
WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1)
SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS id, n FROM c""",
    "sink_project_layout": """
WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1),
m AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS id FROM c WHERE n >= 10),
v AS (SELECT d.doc_id, l.toxic AS y_bin, coalesce(m.id, -1) AS y_fam FROM documents d
      LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN m ON d.source = m.label)
SELECT y_bin, count(*) AS n, count(DISTINCT y_fam) AS n_families FROM v GROUP BY y_bin""",
    "csc_scan": SCAN + """SELECT path, sha256, size, is_pe, is_malware, malware_score, family, family_confidence,
  top_families, error FROM res""",
    "src_corpus": SCAN + "SELECT path, n AS size, CAST(NULL AS VARCHAR) AS error FROM ok",
    "prj_verdict": SCAN + """SELECT path, CASE WHEN error IS NOT NULL THEN 'error' WHEN is_malware IS NULL THEN 'undecided'
  WHEN is_malware THEN 'malware' ELSE 'benign' END AS verdict, round_even(ms_raw, 4) AS malware_score,
  CASE WHEN coalesce(family, '') = '' THEN '-' ELSE family END AS family FROM res""",
    "agg_scan_summary": SCAN + """SELECT count(*) AS total, count_if(is_malware = true) AS n_malware, count_if(is_malware = false) AS n_benign,
  count_if(family = 'unknown') AS n_unknown_family, count_if(error IS NOT NULL) AS n_error FROM res""",
    "sink_scan_csv": SCAN + "SELECT path, family, top_families FROM res",
}


def q_ml_predict_file(spark, sf):
    """``ml_predict_file``: file bytes -> byte-derived vector blocks -> model scores and labels
    (binary model trained on the labelled documents)."""
    from ..operators.featurize import add_raw_from_bytes, vectorize_records
    blocks = ["general", "histogram", "byteentropy", "strings"]
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    v = vectorize_records(add_raw_from_bytes(d, "content", "raw"), "raw", blocks).select("doc_id", "features")
    v = materialise(v, "file-vectors")  # featurised once; training reads keys without vectors, joins see the real size
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    train = v.join(lab, "doc_id").withColumn("sha256", F.col("doc_id").cast("string"))
    m = ml.train_classifier(train, "logreg", {"maxIter": 30, "regParam": 0.01}, "binary", seed=3)
    return ml.predict_labels(m, ml.scores_of(m, v)).select("doc_id", "score", "pred")


QUERIES["ml_predict_file"] = q_ml_predict_file
