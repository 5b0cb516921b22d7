"""A cascade of fitted models: trained, saved, loaded, applied and evaluated as one.

Layer 1 is a binary classifier on all labelled rows. Layer 2 is a multiclass one on
the malicious rows with a known family, and only the rows that layer 1 flags reach
it. The threshold is layer 1's own, the best on its validation rows. Without two families
to tell apart there is no layer 2, and flagged rows have no family.
"""
from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade as cs
from . import metrics as mt
from . import ml


@dataclass
class FittedCascade:
    layer1: ml.TrainedModel
    layer2: ml.TrainedModel | None
    label_map: DataFrame | None = None

    @property
    def classes(self):
        return None if self.layer2 is None else F.array(*[F.lit(c) for c in self.layer2.classes])


def fit_cascade(df: DataFrame, layer1: tuple[str, dict], layer2: tuple[str, dict], y_bin: str = "y_bin", y_fam: str = "y_fam",
                key: str = "sha256", features: str = "features", label_map: DataFrame | None = None, seed: int = 42,
                validation_size: float = 0.2, class_weight_mode: str | None = None) -> FittedCascade:
    """Fits both layers; ``y_bin`` and ``y_fam`` are -1 where unlabelled."""
    first = ml.train_classifier(df, layer1[0], layer1[1], "binary", validation_size, seed, class_weight_mode=class_weight_mode,
                                y=y_bin, key=key, features=features)
    known = df.where((F.col(y_bin) == 1) & (F.col(y_fam) >= 0))
    second = None
    if known.select(y_fam).distinct().limit(2).count() == 2:
        second = ml.train_classifier(known, layer2[0], layer2[1], "multiclass", 0.0, seed, class_weight_mode=class_weight_mode,
                                     y=y_fam, key=key, features=features)
    return FittedCascade(first, second, label_map)


def predict(cascade: FittedCascade, df: DataFrame, threshold: float | None = None, features: str = "features") -> DataFrame:
    """``csc_predict`` with fitted layers: adds malware_score, is_malware, family_id and family_name."""
    return cs.cascade_predict(df, ml.scorer(cascade.layer1, features=features), cascade.layer1.threshold if threshold is None else threshold,
                              None if cascade.layer2 is None else ml.scorer(cascade.layer2, features=features),
                              cascade.label_map, cascade.classes)


def scan(cascade: FittedCascade, df: DataFrame, errors: DataFrame | None = None, top_k: int = 3, min_confidence: float = 0.05,
         features: str = "features") -> DataFrame:
    """``csc_scan`` with fitted layers over (path, sha256, size, is_pe, features)."""
    return cs.scan_results(df, ml.scorer(cascade.layer1, features=features), cascade.layer1.threshold,
                           None if cascade.layer2 is None else ml.scorer(cascade.layer2, features=features),
                           cascade.label_map, cascade.classes, top_k, min_confidence, errors)


def evaluate(cascade: FittedCascade, df: DataFrame, y_bin: str = "y_bin", y_fam: str = "y_fam", features: str = "features") -> DataFrame:
    """``csc_evaluate``: the end-to-end report of the fitted layers at the cascade's own threshold."""
    p = predict(cascade, df.where(F.col(y_bin) != -1), features=features).withColumn("__family", F.coalesce("family_id", F.lit(-1)))
    return mt.cascade_report(p, y_bin, y_fam, "is_malware", "__family").withColumn("threshold", F.lit(cascade.layer1.threshold))


def save(spark: SparkSession, cascade: FittedCascade, path: str) -> None:
    ml.save_model_list(spark, [(i, m) for i, m in ((1, cascade.layer1), (2, cascade.layer2)) if m is not None], path, "layer")
    if cascade.label_map is not None:
        cascade.label_map.select("label", "id").write.mode("overwrite").json(os.path.join(path, "label_map"))


def load(spark: SparkSession, path: str, with_names: bool = True) -> FittedCascade:
    layers = dict(ml.load_model_list(spark, path, "layer"))
    names = spark.read.schema("label string, id int").json(os.path.join(path, "label_map")) if with_names else None
    return FittedCascade(layers[1], layers.get(2), names)
