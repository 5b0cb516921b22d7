"""Two-layer cascade and the scan result.

Layer 1 scores every row; layer 2 runs only on the rows layer 1 flags
(an explicit ``filter`` before the layer-2 transform, so a Python or MLlib
scorer never sees benign rows). The flagged and the benign rows are then put
back together with ``unionByName`` instead of a join, so there is no shuffle.
Scorers are functions ``DataFrame -> DataFrame``: an MLlib model's
``transform`` wrapped by ``ml.scorer`` or a column formula.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .metrics import argmax_class, topk_classes

Scorer = Callable[[DataFrame], DataFrame]

UNKNOWN_FAMILY = "unknown"
TOP_FAMILIES_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                              T.StructField("score", T.DoubleType())]))


def name_lookup(label_map: DataFrame | None) -> Column | None:
    """Names by id as one array of (id, label), from a scalar subquery over the (label, id) table.

    The table has one row for each class of the model, as many as the score array of every row.
    """
    if label_map is None:
        return None
    rows = label_map.where(F.col("id").isNotNull()).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "label"))).alias("names"))
    return rows.scalar()


def name_of(names: Column, cls: Column) -> Column:
    """Label of a class id: at its place where ids are dense, else by search; NULL when missing."""
    here = F.get(names, cls)
    return F.when(here["id"] == cls, here["label"]).otherwise(F.get(F.filter(names, lambda x: x["id"] == cls), F.lit(0))["label"])


def cascade_predict(df: DataFrame, layer1: Scorer, threshold: float, layer2: Scorer | None = None,
                    label_map: DataFrame | None = None, classes: Column | None = None) -> DataFrame:
    """``csc_predict``: is_malware, malware_score, family_id, family_name per row.

    ``layer1`` must add ``malware_score``; ``layer2`` must add ``family_scores``
    (ARRAY<DOUBLE>). family_id / family_name are NULL for benign rows; the
    name is NULL when the id is not in the map (cascade semantics).
    A row without a score has a NULL verdict and is kept. Layer 1 runs once: its
    output is written to the shared folder and both branches read it.
    """
    s1 = materialise(layer1(df).withColumn("is_malware", (F.col("malware_score") >= F.lit(threshold)).cast("int")), "layer1")
    names = name_lookup(label_map)
    flagged = F.coalesce(F.col("is_malware") == 1, F.lit(False))
    rest = s1.where(~flagged).withColumn("family_id", F.lit(None).cast("int"))
    mal = s1.where(flagged)
    if layer2 is not None:
        mal = layer2(mal).withColumn("family_id", argmax_class(F.col("family_scores"), classes)).drop("family_scores")
    else:
        mal = mal.withColumn("family_id", F.lit(None).cast("int"))
    if names is None:
        return rest.unionByName(mal).withColumn("family_name", F.lit(None).cast("string"))
    mal = mal.withColumn("__names", names).withColumn("family_name", name_of(F.col("__names"), F.col("family_id"))).drop("__names")
    return rest.withColumn("family_name", F.lit(None).cast("string")).unionByName(mal)


def resolve_family(scores: Column, classes: Column | None, names: Column | None, top_k: int = 3,
                   min_confidence: float = 0.05) -> Column:
    """``csc_resolve_family``: struct(family, family_confidence, top_families).

    Top-k by score (ties by class id); names from the map, ``class_<id>`` when
    missing; family is ``unknown`` without a map or when the best score is
    below ``min_confidence``."""
    top = topk_classes(scores, classes, top_k)
    def nm(c):
        base = F.concat(F.lit("class_"), c.cast("string"))
        return F.coalesce(name_of(names, c), base) if names is not None else base
    named = F.transform(top, lambda p: F.struct(nm(p["cls"]).alias("name"), p["score"].cast("double").alias("score")))
    best = F.try_element_at(named, F.lit(1))
    fam = (F.when(F.size(named) == 0, F.lit(UNKNOWN_FAMILY))
            .when(F.lit(names is None) | (best["score"] < min_confidence), F.lit(UNKNOWN_FAMILY))
            .otherwise(best["name"]))
    conf = F.when(F.size(named) == 0, F.lit(0.0)).otherwise(best["score"])
    return F.struct(fam.alias("family"), conf.alias("family_confidence"), named.alias("top_families"))


def scan_results(features: DataFrame, layer1: Scorer, threshold: float, layer2: Scorer | None = None,
                 label_map: DataFrame | None = None, classes: Column | None = None, top_k: int = 3,
                 min_confidence: float = 0.05, errors: DataFrame | None = None) -> DataFrame:
    """``csc_scan``: ScanResult rows. ``features`` has path, sha256, size, is_pe and
    what the scorers need; ``errors`` has (path, size, error) rows kept as they
    are. Benign -> family NULL; malware without layer 2 -> ``unknown``; without a score the
    verdict and family stay NULL. The corpus is scanned and scored by layer 1 once."""
    s1 = materialise(layer1(features).withColumn("is_malware", F.col("malware_score") >= F.lit(threshold)), "layer1")
    names = name_lookup(label_map)
    flagged = F.coalesce(F.col("is_malware"), F.lit(False))
    keep = ["path", "sha256", "size", "is_pe", "is_malware", "malware_score"]
    benign = s1.where(~flagged).select(
        *keep, F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("family_confidence"),
        F.array().cast(TOP_FAMILIES_TYPE).alias("top_families"))
    mal = s1.where(flagged)
    if layer2 is not None:
        named = None if names is None else F.col("__names")
        r = resolve_family(F.col("family_scores"), classes, named, top_k, min_confidence)
        mal = layer2(mal)
        mal = (mal if names is None else mal.withColumn("__names", names)).select(*keep, r["family"].alias("family"), r["family_confidence"].alias("family_confidence"),
                                 r["top_families"].alias("top_families"))
    else:
        mal = mal.select(*keep, F.lit(UNKNOWN_FAMILY).alias("family"), F.lit(None).cast("double").alias("family_confidence"),
                         F.array().cast(TOP_FAMILIES_TYPE).alias("top_families"))
    out = benign.unionByName(mal).withColumn("error", F.lit(None).cast("string"))
    if errors is not None:
        err = errors.select("path", F.lit(None).cast("string").alias("sha256"), F.col("size").cast("bigint").alias("size"),
                            F.lit(None).cast("boolean").alias("is_pe"), F.lit(None).cast("boolean").alias("is_malware"),
                            F.lit(None).cast("double").alias("malware_score"), F.lit(None).cast("string").alias("family"),
                            F.lit(None).cast("double").alias("family_confidence"),
                            F.array().cast(TOP_FAMILIES_TYPE).alias("top_families"), F.col("error").cast("string"))
        out = out.unionByName(err)
    return out


def top_families_text(top: Column) -> Column:
    """``sink_scan_csv`` field: "name (0.123); name (0.045)"."""
    return F.array_join(F.transform(top, lambda x: F.format_string("%s (%.3f)", x["name"], x["score"])), "; ")


def verdict(results: DataFrame) -> DataFrame:
    """``prj_verdict``: display columns of a scan result."""
    v = (F.when(F.col("error").isNotNull(), "error").when(F.col("is_malware").isNull(), "undecided")
          .when(F.col("is_malware"), "malware").otherwise("benign"))
    return results.select(
        "path", v.alias("verdict"),
        F.bround(F.col("malware_score"), 4).alias("malware_score"),
        F.when(F.coalesce(F.col("family"), F.lit("")) == "", "-").otherwise(F.col("family")).alias("family"),
        F.bround(F.col("family_confidence"), 4).alias("family_confidence"),
        top_families_text(F.col("top_families")).alias("top_families"))


def scan_summary(results: DataFrame) -> DataFrame:
    """``agg_scan_summary``: total, malware, benign, unknown family, errors."""
    return results.agg(F.count("*").alias("total"),
                       F.count_if(F.col("is_malware") == True).alias("n_malware"),  # noqa: E712
                       F.count_if(F.col("is_malware") == False).alias("n_benign"),  # noqa: E712
                       F.count_if(F.col("family") == UNKNOWN_FAMILY).alias("n_unknown_family"),
                       F.count_if(F.col("error").isNotNull()).alias("n_error"))
