"""Evaluation metrics as DataFrame aggregates.

Binary curve metrics are computed from one table of distinct scores with
(tp, fp) counts. Cumulative sums over that table in descending score order
use range partitioning and per-partition offsets, never a single-partition
window, so they scale with the number of distinct scores. AUC, average
precision, TPR@FPR and partial AUC are then closed-form sums over the
groups (no lag over partition boundaries is needed):

  AUC = (1/PN) * sum_g tp_g * (N - cum_fp_g + fp_g / 2)        (tie-correct)
  AP  = sum_g (tp_g / P) * cum_tp_g / (cum_tp_g + cum_fp_g)      (step sum)

with cum_tp_g, cum_fp_g the cumulative counts including group g.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordering import running_sums


# ---- binary ---------------------------------------------------------------------------------

def score_groups(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, tp, fp, n) per distinct score; partial aggregation before the shuffle."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("bigint").alias("fp"),
        F.count("*").alias("n"))


def stored_groups(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """``score_groups`` written once. Every metric reads the groups several times, and a filter on a bucket of the score
    that the optimizer moves below the grouping would evaluate the score (a model's prediction) once a comparison."""
    return materialise(score_groups(df, y, score), "score-groups")


def cumulative_desc(groups: DataFrame, cols=("tp", "fp"), order: str = "score") -> DataFrame:
    """Adds cum_tp / cum_fp (cumulative, inclusive) in descending ``order`` without a global window."""
    return running_sums(groups, [order], list(cols), descending=True)


def _totals(groups: DataFrame) -> tuple[int, int]:
    """(P, N): positives and negatives, read back as two scalars."""
    r = groups.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")).first()
    return int(r["P"] or 0), int(r["N"] or 0)


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side merge of one-row report frames (each collected: a single row)."""
    spark = frames[0].sparkSession
    fields, values = [], []
    for f in frames:
        r = f.first()
        fields += f.schema.fields
        values += list(r) if r is not None else [None] * len(f.schema.fields)
    from pyspark.sql.types import StructType
    return spark.createDataFrame([tuple(values)], StructType(fields))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """``met_roc_curve`` / ``win_cumulative_curve``: (threshold, fpr, tpr, cum_tp, cum_fp) at each
    distinct score (full curve, no intermediate point dropped)."""
    g = stored_groups(df, y, score)
    P, N = _totals(g)
    c = cumulative_desc(g)
    # a rate over no rows is NULL
    return c.select(F.col("score").alias("threshold"), F.try_divide("cum_fp", F.lit(N)).alias("fpr"),
                    F.try_divide("cum_tp", F.lit(P)).alias("tpr"), "cum_tp", "cum_fp")


def binary_curve_metrics(df: DataFrame, y: str = "y", score: str = "score", max_fpr_tpr: float = 0.01,
                         max_fpr_pauc: float = 0.005, groups: DataFrame | None = None) -> DataFrame:
    """``met_roc_auc``, ``met_pr_auc``, ``met_tpr_at_fpr``, ``met_partial_auc`` in one row.

    ``groups``: the ``stored_groups`` of ``df``, where the caller has them already."""
    g = stored_groups(df, y, score) if groups is None else groups
    p_, n_ = _totals(g)
    c = cumulative_desc(g)
    P, N = F.lit(p_).cast("double"), F.lit(n_).cast("double")
    ctp, cfp = F.col("cum_tp"), F.col("cum_fp")
    fpr, tpr = F.try_divide(cfp, N), F.try_divide(ctp, P)
    fpr0, tpr0 = F.try_divide(cfp - F.col("fp"), N), F.try_divide(ctp - F.col("tp"), P)
    auc_term = F.col("tp") * (N - cfp + F.col("fp") / 2.0)
    ap_term = F.try_divide(F.try_divide(F.col("tp"), P) * ctp, ctp + cfp)
    m = F.lit(max_fpr_pauc)
    inside = (fpr <= m)
    crossing = (fpr0 <= m) & (fpr > m)
    t_at = tpr0 + F.try_divide((tpr - tpr0) * (m - fpr0), fpr - fpr0)
    seg = (F.when(inside, (fpr - fpr0) * (tpr + tpr0) / 2.0)
            .when(crossing, (m - fpr0) * (tpr0 + t_at) / 2.0)
            .when(fpr.isNull() | tpr.isNull(), F.lit(None)).otherwise(0.0))
    agg = c.agg(
        F.try_divide(F.sum(auc_term), P * N).alias("roc_auc"),
        F.sum(ap_term).alias("pr_auc"),
        (F.when(P * N > 0, F.coalesce(F.max(F.when(fpr <= max_fpr_tpr, tpr)), F.lit(0.0)))).alias("tpr_at_fpr_1pct"),
        F.sum(seg).alias("__pauc"))
    min_area, max_area = 0.5 * max_fpr_pauc ** 2, max_fpr_pauc
    return agg.select("roc_auc", "pr_auc", "tpr_at_fpr_1pct",
                      (0.5 * (1 + (F.col("__pauc") - min_area) / (max_area - min_area))).alias("partial_auc"))


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles (numpy default) computed exactly at scale:
    per-value counts, global cumulative counts, then only the values at the
    needed positions are picked (no sort of all rows into one task)."""
    vc = materialise(df.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c")), "value-counts")
    return _quantiles_of_counts(vc, qs)


def _quantiles_of_counts(vc: DataFrame, qs: list[float]) -> DataFrame:
    """``exact_quantiles`` of the values v that occur c times each (NULL counts for nothing); ``vc`` is read several times."""
    spark, vc = vc.sparkSession, vc.where("v is not null")
    n = int(vc.agg(F.sum("c")).first()[0] or 0)
    if n == 0:
        return spark.createDataFrame([], "q double, value double")
    pos = sorted({p for q in qs for p in _virtual_index(n, q)[:2]})
    cum = running_sums(vc, ["v"], ["c"], prefix="before_", inclusive=False).withColumnRenamed("before_c", "before")
    positions = F.array(*[F.lit(p) for p in pos])
    hit = cum.select("v", F.explode(F.filter(positions, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("c")))).alias("p"))
    at = {r_["p"]: r_["v"] for r_ in hit.collect()}  # at most 2 * len(qs) rows
    out = []
    for q in qs:
        lo, hi, g = _virtual_index(n, q)
        out.append((float(q), _lerp(at[lo], at[hi], g)))
    return spark.createDataFrame(out, "q double, value double")


def _virtual_index(n: int, q: float) -> tuple[int, int, float]:
    """numpy's 'linear' quantile position: (lower index, upper index, fraction)."""
    import math
    v = n * q + (1 + q * (1 - 1 - 1)) - 1
    lo = min(max(int(math.floor(v)), 0), n - 1)
    hi = min(lo + 1, n - 1)
    return lo, hi, v - math.floor(v)


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's interpolation step (exact at both ends)."""
    d = b - a
    return float(b - d * (1 - t)) if t >= 0.5 else float(a + d * t)


def best_f1_threshold(df: DataFrame, y: str = "y", score: str = "score", groups: DataFrame | None = None) -> DataFrame:
    """``met_best_f1_threshold``: candidates are the distinct 1%..99% quantiles of the
    scores; the first (lowest) threshold with the strictly best F1 wins;
    (0.5, 0.0) when the input is empty. ``groups`` as for ``binary_curve_metrics``."""
    spark = df.sparkSession
    qs = [round(0.01 * i, 2) for i in range(1, 100)]
    g = stored_groups(df, y, score) if groups is None else groups
    qv = _quantiles_of_counts(g.select(F.col("score").alias("v"), F.col("n").alias("c")), qs)
    cands = sorted({r["value"] for r in qv.collect()})
    if not cands:
        return spark.createDataFrame([(0.5, 0.0)], "threshold double, f1 double")
    arr = F.array(*[F.lit(float(c)) for c in cands])
    P, _ = _totals(g)
    # bucket b = number of candidates <= score; candidate i counts the rows of buckets b > i
    per = (g.withColumn("b", F.size(F.filter(arr, lambda c: c <= F.col("score"))))
            .groupBy("b").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")))   # <= 100 rows
    contrib = per.where("b > 0").select(F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), "tp", "fp")
    counts = contrib.groupBy("i").agg(F.sum("tp").alias("cum_tp"), F.sum("fp").alias("cum_fp"))
    cand_df = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cands)], "i int, threshold double")
    j = cand_df.join(counts, "i", "left").fillna(0, ["cum_tp", "cum_fp"])
    tp, fp = F.col("cum_tp"), F.col("cum_fp")
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + (F.lit(P) - tp)), F.lit(0.0))
    best = j.withColumn("f1", f1).orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)
    return best.select("threshold", "f1")


def threshold_predictions(df: DataFrame, threshold: float, score: str = "score", out: str = "pred") -> DataFrame:
    """``prj_threshold``: (score >= t) as 0/1."""
    return df.withColumn(out, (F.col(score) >= F.lit(threshold)).cast("int"))


def binary_report(df: DataFrame, threshold: float, y: str = "y", score: str = "score",
                  validation_threshold: float | None = None, validation_f1: float | None = None,
                  total_rows: int | None = None) -> DataFrame:
    """``met_binary_report``: the evaluate_classifier bundle for a binary model."""
    lab = df.where(F.col(y) != -1)
    p = threshold_predictions(lab, threshold, score)
    tp = F.count_if((F.col("pred") == 1) & (F.col(y) == 1))
    fp = F.count_if((F.col("pred") == 1) & (F.col(y) != 1))
    fn = F.count_if((F.col("pred") != 1) & (F.col(y) == 1))
    base = p.agg(F.count("*").alias("eval_rows_labeled_after_y_filter"),
                 F.avg((F.col("pred") == F.col(y)).cast("double")).alias("accuracy"),
                 F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
    groups = stored_groups(lab, y, score)
    curve = binary_curve_metrics(lab, y, score, groups=groups)
    best = best_f1_threshold(lab, y, score, groups=groups).select(F.col("threshold").alias("best_eval_threshold_by_f1"),
                                                   F.col("f1").alias("best_eval_f1"))
    total = total_rows if total_rows is not None else df.count()
    return (one_row(base, curve, best)
            .withColumn("eval_rows_total_before_y_filter", F.lit(total).cast("bigint"))
            .withColumn("labeled_row_fraction", F.col("eval_rows_labeled_after_y_filter") / F.greatest(F.lit(total), F.lit(1)))
            .withColumn("threshold", F.lit(float(threshold)))
            .withColumn("validation_threshold", F.lit(validation_threshold).cast("double"))
            .withColumn("validation_f1", F.lit(validation_f1).cast("double")))


# ---- multiclass -----------------------------------------------------------------------------

def argmax_class(scores: Column, classes: Column | None = None) -> Column:
    """``prj_argmax_class``: index of the first maximum, mapped through ``classes``."""
    idx = F.array_position(scores, F.array_max(scores))
    return (F.try_element_at(classes, idx.cast("int")) if classes is not None else idx - 1).cast("int")


def topk_classes(scores: Column, classes: Column | None, k: int) -> Column:
    """``win_topk_families``: k best (class, score) pairs, score desc then class asc."""
    cls = classes if classes is not None else F.sequence(F.lit(0), F.size(scores) - 1)
    pairs = F.arrays_zip(scores.alias("score"), cls.alias("cls"))
    srt = F.array_sort(pairs, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                       .when(a["cls"] < b["cls"], -1).when(a["cls"] > b["cls"], 1).otherwise(0))
    return F.slice(srt, 1, F.least(F.lit(k), F.size(scores)))


def topk_hit(scores: Column, classes: Column | None, y: Column, k: int) -> Column:
    """``met_topk``: y among the min(k, n_classes) best classes."""
    return F.exists(topk_classes(scores, classes, k), lambda p: p["cls"] == y)


def per_class_f1(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(class, support, tp, fp, fn, f1) over the union of true and predicted classes."""
    t = df.groupBy(F.col(y).alias("cls")).agg(F.count("*").alias("support"),
                                               F.count_if(F.col(y) == F.col(pred)).alias("tp"))
    p = df.groupBy(F.col(pred).alias("cls")).agg(F.count("*").alias("npred"))
    j = t.join(p, "cls", "full_outer").fillna(0, ["support", "tp", "npred"])
    j = j.withColumn("fp", F.col("npred") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    return j.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def f1_macro_weighted(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """``met_f1_macro_weighted``."""
    return per_class_f1(df, y, pred).agg(
        F.avg("f1").alias("f1_macro"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1_weighted"))


def multiclass_report(df: DataFrame, y: str = "y", scores: str = "scores", classes: str | None = "classes",
                      ks=(3, 5, 10), total_rows: int | None = None) -> DataFrame:
    """``met_multiclass_report`` (+ ``met_label_stats``, ``met_accuracy``, ``met_topk``)."""
    lab = df.where(F.col(y) != -1)
    cls = F.col(classes) if classes else None
    p = lab.withColumn("pred", argmax_class(F.col(scores), cls))
    for k in ks:
        p = p.withColumn(f"__hit{k}", topk_hit(F.col(scores), cls, F.col(y), k))
    base = p.agg(F.count("*").alias("eval_rows_labeled_after_y_filter"),
                 F.count_distinct(y).alias("num_true_classes_in_eval"),
                 F.count_distinct("pred").alias("num_predicted_classes_in_eval"),
                 F.avg((F.col("pred") == F.col(y)).cast("double")).alias("accuracy"),
                 *[(F.count_if(f"__hit{k}") / F.greatest(F.count("*"), F.lit(1))).alias(f"top_{k}_accuracy") for k in ks])
    total = total_rows if total_rows is not None else df.count()
    return (one_row(base, f1_macro_weighted(p, y, "pred"))
            .withColumn("eval_rows_total_before_y_filter", F.lit(total).cast("bigint"))
            .withColumn("labeled_row_fraction", F.col("eval_rows_labeled_after_y_filter") / F.greatest(F.lit(total), F.lit(1))))


# ---- multilabel / cascade ---------------------------------------------------------------------

def multilabel_report(df: DataFrame, y: str = "y", scores: str = "scores", threshold: float = 0.5) -> DataFrame:
    """``met_multilabel``: exact match, macro and support-weighted F1 over label columns."""
    lab = df.where(F.aggregate(F.col(y), F.lit(0), lambda a, x: a + x) > 0)
    p = lab.withColumn("__pred", F.transform(F.col(scores), lambda s: (s >= threshold).cast("int")))
    p = p.withColumn("__pred", F.slice("__pred", 1, F.size(F.col(y))))
    exact = p.agg(F.avg(F.forall(F.arrays_zip(F.col(y).alias("a"), F.col("__pred").alias("b")),
                                 lambda e: e["a"] == e["b"]).cast("double")).alias("exact_match"))
    cells = p.select(F.posexplode(F.arrays_zip(F.col(y).alias("t"), F.col("__pred").alias("q"))).alias("j", "e"))
    per = cells.groupBy("j").agg(F.count_if((F.col("e.t") == 1) & (F.col("e.q") == 1)).alias("tp"),
                                 F.count_if((F.col("e.t") == 0) & (F.col("e.q") == 1)).alias("fp"),
                                 F.count_if((F.col("e.t") == 1) & (F.col("e.q") == 0)).alias("fn"))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    sup = F.col("tp") + F.col("fn")
    f1s = per.agg(F.avg("f1").alias("f1_macro"),
                  F.coalesce(F.try_divide(F.sum(F.col("f1") * sup), F.sum(sup)), F.lit(0.0)).alias("f1_weighted"))
    return one_row(exact, f1s)


def cascade_report(df: DataFrame, y_bin: str = "y_bin", y_fam: str = "y_fam", pred1: str = "pred1",
                   fam_pred: str = "family_pred") -> DataFrame:
    """``met_cascade``: binary accuracy, malware recall, predicted malware, true-family
    samples and end-to-end family accuracy (both layers right)."""
    tf = F.col(y_fam) != -1
    return df.agg(
        F.avg((F.col(pred1) == F.col(y_bin)).cast("double")).alias("binary_accuracy"),
        F.coalesce(F.try_divide(F.count_if((F.col(y_bin) == 1) & (F.col(pred1) == 1)), F.count_if(F.col(y_bin) == 1)),
                   F.lit(0.0)).alias("binary_malware_recall"),
        F.count_if(F.col(pred1) == 1).alias("predicted_malware_count"),
        F.count_if(tf).alias("true_family_samples"),
        F.coalesce(F.try_divide(F.count_if(tf & (F.col(fam_pred) == F.col(y_fam)) & (F.col(pred1) == 1)), F.count_if(tf)),
                   F.lit(0.0)).alias("end_to_end_family_accuracy"))
