"""Registered queries of the prepare job and of fitted cascades.

The prepare job runs on JSONL files that are written from the stand-in records; the
cascade is fitted on the training rows of ``embeddings`` and applied to the test rows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fitted_cascade as fc
from ..operators import labels as lb
from ..operators import ml
from ..operators import prepare as pr
from ..operators.audit import split_from_path
from ..session import scratch_path
from ..sources import corpus as cp
from ..sources import standins
from .ml_q import emb

#: The stand-in records carry numbers of this block only.
BLOCKS = ["general"]
SUBSETS = ("train", "test", "challenge")


def _prepared(spark, sf) -> pr.Prepared:
    folder = standins.landed_lines(spark, sf)
    out = scratch_path(spark, f"prepared-{uuid.uuid4().hex}")
    pr.prepare(spark, folder, out, SUBSETS, 10, blocks=BLOCKS, pattern="*", recursive=True)
    return pr.load_prepared(spark, out)


def q_prepare_vectors(spark, sf):
    """The written feature and label tables, read back and joined bucket by bucket: counts and sums of each subset."""
    p = _prepared(spark, sf)
    rows = pr.open_table(spark, p, "features").join(pr.open_table(spark, p, "binary").select("row_id", F.col("y").alias("y_bin")), "row_id")
    rows = rows.join(pr.open_table(spark, p, "family").select("row_id", F.col("y").alias("y_fam")), "row_id")
    at = lambda i: F.sum(F.col("features")[i].cast("double"))
    return rows.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("n_files"), F.min(F.size("features")).alias("width"),
        F.count_if(F.col("y_bin") == 1).alias("n_malware"), F.count_if(F.col("y_bin") == -1).alias("n_unlabelled"),
        F.count_if(F.col("y_fam") >= 0).alias("n_family"), F.sum("y_fam").alias("sum_family"),
        at(0).alias("sum_size"), F.round(at(1), 4).alias("sum_entropy"), at(2).alias("sum_is_pe"))


def q_prepare_read(spark, sf):
    """The vector reader with its checks: rows, width and faults come from the one read."""
    p = _prepared(spark, sf)
    out = []
    for target in ("binary", "family"):
        rows, check = pr.read_vectors(spark, p, "train", target)
        total = rows.agg(F.sum("y")).first()[0]
        got = check.verify()
        out.append((target, got["n"], p.width, got["odd_width"] + got["no_label"], p.tables[target]["n_bad"], total))
    return spark.createDataFrame(out, "target string, n long, width int, n_faults long, n_bad_lines long, sum_y long")


def _cascade(spark, sf):
    rows = (emb(spark, sf).withColumnRenamed("y_cls", "y_fam").withColumn("y_fam", F.when(F.col("y_bin") == 1, F.col("y_fam") - 5).otherwise(-1)))
    train, test = rows.where(~F.col("is_val")).drop("is_val"), rows.where(F.col("is_val")).drop("is_val")
    names = lb.build_label_map(train.where("y_fam >= 0").withColumn("name", F.concat(F.lit("family_"), F.col("y_fam").cast("string"))), "name", 1)
    names = names.select("label", F.regexp_extract("label", r"(\d+)$", 1).cast("int").alias("id"))
    fitted = fc.fit_cascade(train, ("logreg", {"maxIter": 40}), ("passive_aggressive", {"epochs": 3}), label_map=names)
    path = scratch_path(spark, f"cascade-{uuid.uuid4().hex}")
    fc.save(spark, fitted, path)
    return fc.load(spark, path), test


def q_csc_fitted_predict(spark, sf):
    """Test rows through a cascade that was fitted, saved and loaded again."""
    cascade, test = _cascade(spark, sf)
    return fc.predict(cascade, test).select("vec_id", "is_malware", "malware_score", "family_id", "family_name")


def q_csc_fitted_evaluate(spark, sf):
    cascade, test = _cascade(spark, sf)
    return fc.evaluate(cascade, test)


def q_csc_fitted_scan(spark, sf):
    cascade, test = _cascade(spark, sf)
    files = test.select(F.concat(F.lit("/corpus/"), "sha256").alias("path"), "sha256", F.size("features").cast("long").alias("size"),
                        F.lit(True).alias("is_pe"), "features")
    return fc.scan(cascade, files)


def q_ml_passive_aggressive(spark, sf):
    rows = emb(spark, sf).withColumn("y", F.col("y_cls"))
    model = ml.train_classifier(rows.where(~F.col("is_val")).drop("is_val"), "passive_aggressive", {"epochs": 4}, "multiclass", 0.0, seed=5)
    return ml.evaluate(model, rows.where(F.col("is_val")).drop("is_val"))


def q_ft_categorical_meta(spark, sf):
    """The categorical slots as a tree learner reads them: vectors of the prepared table with their metadata, a fitted tree,
    and for each slot the values that the table holds."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from ..functions import pe
    p = _prepared(spark, sf)
    rows, _ = pr.read_vectors(spark, p, "train")
    known = rows.where("y >= 0").withColumn("label", F.col("y").cast("double"))
    d = ml.with_categorical_vector(known, p.width, pe.CATEGORICAL_VALUES)
    # the learner takes no more values of a category than it has rows
    n = known.count()
    fit = ml.with_categorical_vector(known, p.width, {i: v for i, v in pe.CATEGORICAL_VALUES.items() if v <= n})
    tree = DecisionTreeClassifier(featuresCol="fv", labelCol="label", maxDepth=3, maxBins=256).fit(fit)
    found = ml.read_slots(d).withColumn("n_features", F.lit(tree.numFeatures))
    held = d.select(F.posexplode("features").alias("slot", "value")).groupBy("slot").agg(F.countDistinct("value").alias("n_held"))
    return found.join(held, "slot").select("slot", "n_values", "n_held", "n_features")


def q_src_corpus_folder(spark, sf):
    """A folder of files read as they are (``binaryFile``): sizes from the listing against the bytes read, by split."""
    folder = standins.landed_lines(spark, sf)
    ok, errors = cp.scan_folder(spark, folder, extensions=(".txt",), max_file_size_mb=512)
    files = ok.select(split_from_path(F.col("path")).alias("split"), "length", F.length("content").alias("n"), F.lit(0).alias("e"))
    bad = errors.select(split_from_path(F.col("path")).alias("split"), F.col("size").alias("length"), F.lit(0).alias("n"), F.lit(1).alias("e"))
    return files.unionByName(bad).groupBy("split").agg(F.sum("length").alias("n_listed"), F.sum("n").alias("n_read"), F.sum("e").alias("n_errors"))


def q_ml_tune_boosted(spark, sf):
    """Boosted-tree grid over expanding folds: fold scores, the best point marked, and its refitted model's threshold."""
    rows = emb(spark, sf).withColumn("y", F.col("y_bin")).drop("is_val")
    grid = [{"maxIter": i, "maxDepth": d} for i in (3, 6) for d in (2, 3)]
    table, model = ml.tune_and_refit(rows, ["vec_id"], grid, "gbt", 3)
    return table.withColumn("threshold", F.when(F.col("best"), F.lit(model.threshold)))


QUERIES = {
    "src_corpus_folder": q_src_corpus_folder,
    "ml_tune_boosted": q_ml_tune_boosted,
    "ft_categorical_meta": q_ft_categorical_meta,
    "prepare_vectors": q_prepare_vectors,
    "prepare_read": q_prepare_read,
    "csc_fitted_predict": q_csc_fitted_predict,
    "csc_fitted_evaluate": q_csc_fitted_evaluate,
    "csc_fitted_scan": q_csc_fitted_scan,
    "ml_passive_aggressive": q_ml_passive_aggressive,
}

ROWS = f"""
WITH lines AS ({standins.record_sql("duckdb")}),
good AS (SELECT split, CAST(value AS JSON) AS j FROM lines WHERE trim(value) <> '' AND json_valid(value)),
bad AS (SELECT count(*) AS n FROM lines WHERE trim(value) <> '' AND NOT json_valid(value)),
v AS (SELECT split AS subset, j ->> '$.sha256' AS sha256, coalesce(CAST(j ->> '$.label' AS INTEGER), -1) AS y_bin, j ->> '$.family' AS family,
             CAST(CAST(j ->> '$.general.size' AS FLOAT) AS DOUBLE) AS size, CAST(CAST(j ->> '$.general.entropy' AS FLOAT) AS DOUBLE) AS entropy,
             CAST(j ->> '$.general.is_pe' AS DOUBLE) AS is_pe FROM good),
c AS (SELECT family AS label, count(*) AS n FROM v WHERE subset = 'train' AND family IS NOT NULL
      AND family NOT IN ('', 'win32', 'win64', 'elf', 'linux', 'pdf', 'apk', 'android') GROUP BY 1),
m AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS id FROM c WHERE n >= 10),
r AS (SELECT v.*, coalesce(m.id, -1) AS y_fam FROM v LEFT JOIN m ON v.family = m.label)
"""

ORACLE = {
    "src_corpus_folder": f"""
WITH lines AS ({standins.record_sql("duckdb")})
SELECT split, CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS n_listed, CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS n_read, 0 AS n_errors
FROM lines GROUP BY split""",
    "ft_categorical_meta": ROWS + """
SELECT slot, CASE WHEN slot = 2 THEN 2 ELSE 256 END AS n_values, CASE WHEN slot = 2 THEN (SELECT count(DISTINCT is_pe) FROM r WHERE subset = 'train' AND y_bin >= 0) ELSE 1 END AS n_held,
       7 AS n_features
FROM (SELECT unnest([2, 3, 4, 5, 6]) AS slot)""",
    "prepare_vectors": ROWS + """
SELECT subset, count(*) AS n, count(DISTINCT sha256) AS n_files, 7 AS width, count_if(y_bin = 1) AS n_malware, count_if(y_bin = -1) AS n_unlabelled,
       count_if(y_fam >= 0) AS n_family, CAST(sum(y_fam) AS BIGINT) AS sum_family, sum(size) AS sum_size, round(sum(entropy), 4) AS sum_entropy,
       sum(is_pe) AS sum_is_pe
FROM r GROUP BY subset""",
    "prepare_read": ROWS + """
SELECT 'binary' AS target, count(*) AS n, 7 AS width, 0 AS n_faults, (SELECT n FROM bad) AS n_bad_lines, CAST(sum(y_bin) AS BIGINT) AS sum_y FROM r WHERE subset = 'train'
UNION ALL
SELECT 'family', count(*), 7, 0, (SELECT n FROM bad), CAST(sum(y_fam) AS BIGINT) FROM r WHERE subset = 'train'""",
}
