"""Registered metric / cascade queries with formula scores on the driver tables.

Binary (with ties): ``events``, y = event_type is 'error', score = value.
Multiclass: ``embeddings``, y = label (label 9 = unlabeled, -1), class
scores = the first ten embedding elements. Multilabel: three label columns
derived from ``label``, scores = elements 11..13, threshold 0. Cascade:
layer-1 score = element 1, threshold 0; families = labels 5..8 (label 9
is a family the map does not know), layer-2 scores = elements 2..5.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade as cs
from ..operators import metrics as mt
from ..sources.tables import table


def binary(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"))


def multiclass(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("y"),
                    F.slice("embedding", 1, 10).cast("array<double>").alias("scores"),
                    F.sequence(F.lit(0), F.lit(9)).alias("classes"))


def multilabel(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    y = F.array((F.col("label") >= 5).cast("int"), (F.col("label") % 2 == 0).cast("int"),
                F.col("label").isin(1, 4, 7).cast("int"))
    return e.select("vec_id", y.alias("y"), F.slice("embedding", 11, 3).cast("array<double>").alias("scores"))


def cascade_input(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y_bin"),
                    F.when(F.col("label").between(5, 8), F.col("label") - 5).otherwise(-1).alias("y_fam"), "label")


def family_map(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").where(F.col("label").between(5, 8))
    return e.select(F.concat(F.lit("fam"), (F.col("label") - 5).cast("string")).alias("label"),
                    (F.col("label") - 5).cast("int").alias("id")).distinct()


def layer1(df):
    return df.withColumn("malware_score", F.col("embedding")[0].cast("double"))


def layer2(df):
    return df.withColumn("family_scores", F.slice("embedding", 2, 4).cast("array<double>"))


def q_met_roc_curve(spark, sf):
    return mt.roc_curve(binary(spark, sf)).select("threshold", "fpr", "tpr")


def q_win_cumulative_curve(spark, sf):
    return mt.roc_curve(binary(spark, sf)).select("threshold", "cum_tp", "cum_fp")


def _curve_metric(name):
    def q(spark, sf):
        return mt.binary_curve_metrics(binary(spark, sf)).select(name)
    return q


def q_met_best_f1_threshold(spark, sf):
    return mt.best_f1_threshold(binary(spark, sf))


def q_met_accuracy(spark, sf):
    b = mt.threshold_predictions(binary(spark, sf), 20.0)
    m = multiclass(spark, sf).where("y <> -1").withColumn("pred", mt.argmax_class(F.col("scores"), F.col("classes")))
    a = b.agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("binary_accuracy"))
    c = m.agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("multiclass_accuracy"))
    return mt.one_row(a, c)


def q_met_f1_binary(spark, sf):
    b = mt.threshold_predictions(binary(spark, sf), 20.0)
    tp = F.count_if((F.col("pred") == 1) & (F.col("y") == 1))
    fp = F.count_if((F.col("pred") == 1) & (F.col("y") == 0))
    fn = F.count_if((F.col("pred") == 0) & (F.col("y") == 1))
    return b.agg(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def q_prj_threshold(spark, sf):
    return mt.threshold_predictions(binary(spark, sf), 25.0).select("event_id", "pred")


def q_met_binary_report(spark, sf):
    r = mt.binary_report(binary(spark, sf), threshold=20.0, validation_threshold=0.5)
    return r.drop("validation_f1")


def q_prj_argmax_class(spark, sf):
    m = multiclass(spark, sf)
    return m.select("vec_id", mt.argmax_class(F.col("scores"), F.col("classes")).alias("pred"))


def q_win_topk_families(spark, sf):
    m = multiclass(spark, sf)
    t = m.select("vec_id", F.posexplode(mt.topk_classes(F.col("scores"), F.col("classes"), 3)).alias("pos", "p"))
    return t.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("p.cls").alias("cls"), F.col("p.score").alias("score"))


def q_met_topk(spark, sf):
    m = multiclass(spark, sf).where("y <> -1")
    return m.agg(*[F.avg(mt.topk_hit(F.col("scores"), F.col("classes"), F.col("y"), k).cast("double")).alias(f"top_{k}_accuracy")
                   for k in (3, 5, 10)])


def q_met_f1_macro_weighted(spark, sf):
    m = multiclass(spark, sf).where("y <> -1").withColumn("pred", mt.argmax_class(F.col("scores"), F.col("classes")))
    return mt.f1_macro_weighted(m)


def q_met_label_stats(spark, sf):
    r = mt.multiclass_report(multiclass(spark, sf))
    return r.select("eval_rows_total_before_y_filter", "eval_rows_labeled_after_y_filter", "labeled_row_fraction",
                    "num_true_classes_in_eval", "num_predicted_classes_in_eval")


def q_met_multiclass_report(spark, sf):
    return mt.multiclass_report(multiclass(spark, sf))


def q_met_multilabel(spark, sf):
    return mt.multilabel_report(multilabel(spark, sf), threshold=0.0)


def q_flt_labeled(spark, sf):
    b = multiclass(spark, sf).agg(F.count_if(F.col("y") != -1).alias("n_binary_kept"))
    m = multilabel(spark, sf).agg(F.count_if(F.aggregate("y", F.lit(0), lambda a, x: a + x) > 0).alias("n_multilabel_kept"))
    return mt.one_row(b, m)


def _cascade(spark, sf):
    d = cascade_input(spark, sf)
    classes = F.sequence(F.lit(0), F.lit(3))
    return cs.cascade_predict(d, layer1, 0.0, layer2, family_map(spark, sf), classes)


def q_csc_predict(spark, sf):
    return _cascade(spark, sf).select("vec_id", "is_malware", "malware_score", "family_id", "family_name")


def q_met_cascade(spark, sf):
    p = _cascade(spark, sf).withColumn("family_pred", F.coalesce("family_id", F.lit(-1)))
    return mt.cascade_report(p, "y_bin", "y_fam", "is_malware", "family_pred")


def q_csc_evaluate(spark, sf):
    """End-to-end: the cascade's own threshold is used for layer 1 (the fixed behaviour)."""
    return q_met_cascade(spark, sf)


def q_csc_resolve_family(spark, sf):
    d = cascade_input(spark, sf).where(F.col("embedding")[0] >= 0.0)
    d = d.withColumn("__names", cs.name_lookup(family_map(spark, sf)))
    names = F.col("__names")
    r = cs.resolve_family(F.slice("embedding", 2, 4).cast("array<double>"), F.sequence(F.lit(0), F.lit(3)), names, 3, 0.05)
    return d.select("vec_id", r["family"].alias("family"), r["family_confidence"].alias("family_confidence"),
                    cs.top_families_text(r["top_families"]).alias("top_families"))


QUERIES = {
    "met_roc_curve": q_met_roc_curve,
    "win_cumulative_curve": q_win_cumulative_curve,
    "met_roc_auc": _curve_metric("roc_auc"),
    "met_pr_auc": _curve_metric("pr_auc"),
    "met_tpr_at_fpr": _curve_metric("tpr_at_fpr_1pct"),
    "met_partial_auc": _curve_metric("partial_auc"),
    "met_best_f1_threshold": q_met_best_f1_threshold,
    "ml_threshold_select": q_met_best_f1_threshold,
    "met_accuracy": q_met_accuracy,
    "met_f1_binary": q_met_f1_binary,
    "prj_threshold": q_prj_threshold,
    "met_binary_report": q_met_binary_report,
    "prj_argmax_class": q_prj_argmax_class,
    "win_topk_families": q_win_topk_families,
    "met_topk": q_met_topk,
    "met_f1_macro_weighted": q_met_f1_macro_weighted,
    "met_label_stats": q_met_label_stats,
    "met_multiclass_report": q_met_multiclass_report,
    "met_multilabel": q_met_multilabel,
    "flt_labeled": q_flt_labeled,
    "csc_predict": q_csc_predict,
    "met_cascade": q_met_cascade,
    "csc_evaluate": q_csc_evaluate,
    "csc_resolve_family": q_csc_resolve_family,
}

# ---- DuckDB oracles ---------------------------------------------------------------------------

BIN = """
WITH b AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value AS score FROM events),
g AS (SELECT score, sum(y) AS tp, sum(1 - y) AS fp FROM b GROUP BY score),
t AS (SELECT sum(tp) AS p, sum(fp) AS n FROM g),
c AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp FROM g),
k AS (SELECT c.*, t.p, t.n, cfp / n AS fpr, ctp / p AS tpr, (cfp - fp) / n AS fpr0, (ctp - tp) / p AS tpr0 FROM c, t)
"""
CURVE = BIN + """
, m AS (SELECT sum(tp * (n - cfp + fp / 2.0)) / (any_value(p) * any_value(n)) AS roc_auc,
          sum(tp / p * ctp / (ctp + cfp)) AS pr_auc,
          coalesce(max(CASE WHEN fpr <= 0.01 THEN tpr END), 0.0) AS tpr_at_fpr_1pct,
          sum(CASE WHEN fpr <= 0.005 THEN (fpr - fpr0) * (tpr + tpr0) / 2.0
                   WHEN fpr0 <= 0.005 AND fpr > 0.005 THEN
                        (0.005 - fpr0) * (tpr0 + (tpr0 + (tpr - tpr0) * (0.005 - fpr0) / (fpr - fpr0))) / 2.0
                   ELSE 0.0 END) AS pauc FROM k)
"""
PAUC = "0.5 * (1 + (pauc - 0.5 * 0.005 * 0.005) / (0.005 - 0.5 * 0.005 * 0.005))"
QS = ", ".join(f"{i / 100:.2f}" for i in range(1, 100))
BEST = BIN + f"""
, q AS (SELECT unnest(quantile_cont(score, [{QS}])) AS t FROM b),
cand AS (SELECT DISTINCT t FROM q),
f AS (SELECT cand.t, sum(CASE WHEN b.score >= cand.t AND b.y = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN b.score >= cand.t AND b.y = 0 THEN 1 ELSE 0 END) AS fp FROM cand, b GROUP BY cand.t),
best AS (SELECT f.t AS threshold, coalesce(2.0 * tp / nullif(2.0 * tp + fp + (t.p - tp), 0), 0.0) AS f1 FROM f, t
         ORDER BY f1 DESC, threshold ASC LIMIT 1)
"""
MC = """
WITH m AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS y, CAST(embedding[1:10] AS DOUBLE[]) AS scores FROM embeddings),
l AS (SELECT *, list_position(scores, list_max(scores)) - 1 AS pred FROM m WHERE y <> -1),
cells AS (SELECT l.vec_id, l.y, s.score, s.cls FROM l, (SELECT vec_id, unnest(scores) AS score, unnest(range(0, 10)) AS cls FROM l) s WHERE s.vec_id = l.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls ASC) AS r FROM cells),
hits AS (SELECT vec_id, max(CASE WHEN r <= 3 AND cls = y THEN 1 ELSE 0 END) AS h3, max(CASE WHEN r <= 5 AND cls = y THEN 1 ELSE 0 END) AS h5,
                max(CASE WHEN r <= 10 AND cls = y THEN 1 ELSE 0 END) AS h10 FROM rk GROUP BY vec_id),
tr AS (SELECT y AS cls, count(*) AS support, count_if(y = pred) AS tp FROM l GROUP BY y),
pr AS (SELECT pred AS cls, count(*) AS npred FROM l GROUP BY pred),
pc AS (SELECT coalesce(tr.cls, pr.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(npred, 0) AS npred
       FROM tr FULL OUTER JOIN pr ON tr.cls = pr.cls),
f1 AS (SELECT avg(coalesce(2.0 * tp / nullif(2.0 * tp + (npred - tp) + (support - tp), 0), 0.0)) AS f1_macro,
              sum(coalesce(2.0 * tp / nullif(2.0 * tp + (npred - tp) + (support - tp), 0), 0.0) * support) / sum(support) AS f1_weighted FROM pc),
base AS (SELECT count(*) AS eval_rows_labeled_after_y_filter, count(DISTINCT y) AS num_true_classes_in_eval,
                count(DISTINCT pred) AS num_predicted_classes_in_eval, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM l),
tk AS (SELECT avg(h3) AS top_3_accuracy, avg(h5) AS top_5_accuracy, avg(h10) AS top_10_accuracy FROM hits),
tot AS (SELECT count(*) AS eval_rows_total_before_y_filter FROM m)
"""
CAS = """
WITH d AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS malware_score, CAST(embedding[2:5] AS DOUBLE[]) AS fs,
                  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y_bin, CASE WHEN label BETWEEN 5 AND 8 THEN label - 5 ELSE -1 END AS y_fam
           FROM embeddings),
fm AS (SELECT DISTINCT 'fam' || CAST(label - 5 AS VARCHAR) AS name, label - 5 AS id FROM embeddings WHERE label BETWEEN 5 AND 8),
p AS (SELECT d.*, CASE WHEN malware_score >= 0.0 THEN 1 ELSE 0 END AS is_malware,
             CASE WHEN malware_score >= 0.0 THEN list_position(fs, list_max(fs)) - 1 END AS family_id FROM d)
"""

ORACLE = {
    "met_roc_curve": BIN + "SELECT score AS threshold, fpr, tpr FROM k",
    "win_cumulative_curve": BIN + "SELECT score AS threshold, ctp AS cum_tp, cfp AS cum_fp FROM k",
    "met_roc_auc": CURVE + "SELECT roc_auc FROM m",
    "met_pr_auc": CURVE + "SELECT pr_auc FROM m",
    "met_tpr_at_fpr": CURVE + "SELECT tpr_at_fpr_1pct FROM m",
    "met_partial_auc": CURVE + f"SELECT {PAUC} AS partial_auc FROM m",
    "met_best_f1_threshold": BEST + "SELECT threshold, f1 FROM best",
    "ml_threshold_select": BEST + "SELECT threshold, f1 FROM best",
    "met_accuracy": MC + """, bacc AS (SELECT avg(CASE WHEN (CASE WHEN value >= 20.0 THEN 1 ELSE 0 END) = (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
                                      THEN 1.0 ELSE 0.0 END) AS binary_accuracy FROM events)
SELECT binary_accuracy, accuracy AS multiclass_accuracy FROM bacc, base""",
    "met_f1_binary": """
WITH b AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, CASE WHEN value >= 20.0 THEN 1 ELSE 0 END AS pred FROM events),
c AS (SELECT count_if(pred = 1 AND y = 1) AS tp, count_if(pred = 1 AND y = 0) AS fp, count_if(pred = 0 AND y = 1) AS fn FROM b)
SELECT coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c""",
    "prj_threshold": "SELECT event_id, CAST(value >= 25.0 AS INTEGER) AS pred FROM events",
    "met_binary_report": CURVE + BEST[len(BIN):] + f"""
, base AS (SELECT count(*) AS eval_rows_labeled_after_y_filter,
                  avg(CASE WHEN (CASE WHEN score >= 20.0 THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy,
                  coalesce(2.0 * count_if(score >= 20.0 AND y = 1) / nullif(2.0 * count_if(score >= 20.0 AND y = 1)
                           + count_if(score >= 20.0 AND y = 0) + count_if(score < 20.0 AND y = 1), 0), 0.0) AS f1 FROM b)
SELECT base.eval_rows_labeled_after_y_filter, base.accuracy, base.f1, roc_auc, pr_auc, tpr_at_fpr_1pct, {PAUC} AS partial_auc,
       best.threshold AS best_eval_threshold_by_f1, best.f1 AS best_eval_f1,
       base.eval_rows_labeled_after_y_filter AS eval_rows_total_before_y_filter, 1.0 AS labeled_row_fraction,
       20.0 AS threshold, 0.5 AS validation_threshold
FROM base, m, best""",
    "prj_argmax_class": """
SELECT vec_id, CAST(list_position(CAST(embedding[1:10] AS DOUBLE[]), list_max(CAST(embedding[1:10] AS DOUBLE[]))) - 1 AS INTEGER) AS pred
FROM embeddings""",
    "win_topk_families": """
WITH c AS (SELECT vec_id, unnest(CAST(embedding[1:10] AS DOUBLE[])) AS score, unnest(range(0, 10)) AS cls FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls ASC) AS rank FROM c)
SELECT vec_id, rank, CAST(cls AS INTEGER) AS cls, score FROM r WHERE rank <= 3""",
    "met_topk": MC + "SELECT * FROM tk",
    "met_f1_macro_weighted": MC + "SELECT * FROM f1",
    "met_label_stats": MC + """SELECT eval_rows_total_before_y_filter, eval_rows_labeled_after_y_filter,
  eval_rows_labeled_after_y_filter / eval_rows_total_before_y_filter AS labeled_row_fraction,
  num_true_classes_in_eval, num_predicted_classes_in_eval FROM base, tot""",
    "met_multiclass_report": MC + """SELECT eval_rows_labeled_after_y_filter, num_true_classes_in_eval, num_predicted_classes_in_eval,
  accuracy, top_3_accuracy, top_5_accuracy, top_10_accuracy, f1_macro, f1_weighted, eval_rows_total_before_y_filter,
  eval_rows_labeled_after_y_filter / eval_rows_total_before_y_filter AS labeled_row_fraction FROM base, tk, f1, tot""",
    "met_multilabel": """
WITH m AS (SELECT vec_id, [CAST(label >= 5 AS INTEGER), CAST(label % 2 = 0 AS INTEGER), CAST(label IN (1, 4, 7) AS INTEGER)] AS y,
                  CAST(embedding[11:13] AS DOUBLE[]) AS s FROM embeddings),
l AS (SELECT * FROM m WHERE list_sum(y) > 0),
cells AS (SELECT vec_id, unnest(y) AS t, unnest(list_transform(s, lambda x: CAST(x >= 0.0 AS INTEGER))) AS q,
                 unnest(range(0, 3)) AS j FROM l),
ex AS (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS exact_match FROM (SELECT vec_id, bool_and(t = q) AS ok FROM cells GROUP BY vec_id)),
per AS (SELECT j, count_if(t = 1 AND q = 1) AS tp, count_if(t = 0 AND q = 1) AS fp, count_if(t = 1 AND q = 0) AS fn FROM cells GROUP BY j),
f AS (SELECT avg(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0)) AS f1_macro,
             sum(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) * (tp + fn)) / sum(tp + fn) AS f1_weighted FROM per)
SELECT exact_match, f1_macro, f1_weighted FROM ex, f""",
    "flt_labeled": """
SELECT count_if(label <> 9) AS n_binary_kept,
       count_if(CAST(label >= 5 AS INTEGER) + CAST(label % 2 = 0 AS INTEGER) + CAST(label IN (1, 4, 7) AS INTEGER) > 0) AS n_multilabel_kept
FROM embeddings""",
    "csc_predict": CAS + """
SELECT vec_id, is_malware, malware_score, CAST(family_id AS INTEGER) AS family_id, fm.name AS family_name
FROM p LEFT JOIN fm ON p.family_id = fm.id""",
    "met_cascade": CAS + """
SELECT avg(CASE WHEN is_malware = y_bin THEN 1.0 ELSE 0.0 END) AS binary_accuracy,
  coalesce(count_if(y_bin = 1 AND is_malware = 1) / nullif(count_if(y_bin = 1), 0), 0.0) AS binary_malware_recall,
  count_if(is_malware = 1) AS predicted_malware_count, count_if(y_fam <> -1) AS true_family_samples,
  coalesce(count_if(y_fam <> -1 AND coalesce(family_id, -1) = y_fam AND is_malware = 1) / nullif(count_if(y_fam <> -1), 0), 0.0)
    AS end_to_end_family_accuracy
FROM p""",
    "csc_resolve_family": CAS + """
, c AS (SELECT vec_id, unnest(fs) AS score, unnest(range(0, 4)) AS cls FROM p WHERE is_malware = 1),
r AS (SELECT c.*, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls ASC) AS rank,
             coalesce(fm.name, 'class_' || CAST(cls AS VARCHAR)) AS name FROM c LEFT JOIN fm ON c.cls = fm.id),
t AS (SELECT vec_id, string_agg(printf('%s (%.3f)', name, score), '; ' ORDER BY rank) AS top_families,
             max(CASE WHEN rank = 1 THEN score END) AS best, max(CASE WHEN rank = 1 THEN name END) AS best_name FROM r WHERE rank <= 3 GROUP BY vec_id)
SELECT vec_id, CASE WHEN best < 0.05 THEN 'unknown' ELSE best_name END AS family, best AS family_confidence, top_families FROM t""",
}
ORACLE["csc_evaluate"] = ORACLE["met_cascade"]
