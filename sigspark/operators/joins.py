"""Lookup joins of the label layer; adaptive execution broadcasts a side by its measured bytes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def lookup_id(df: DataFrame, key: Column | str, mapping: DataFrame, key_col: str = "label",
              id_col: str = "id", out: str = "y", default: int = -1) -> DataFrame:
    """``join_label_map`` / ``prj_encode_label``: left join label -> id, missing -> default."""
    k = F.col(key) if isinstance(key, str) else key
    m = mapping.select(F.col(key_col).alias("__k"), F.col(id_col).alias("__id"))
    return (df.join(m, k == F.col("__k"), "left")
              .withColumn(out, F.coalesce(F.col("__id"), F.lit(default)).cast("int"))
              .drop("__k", "__id"))


def lookup_name(df: DataFrame, id_col: str, mapping: DataFrame, out: str = "name",
                fallback_prefix: str | None = None) -> DataFrame:
    """``join_inverse_map``: id -> name. Cascade style gives null for an unknown id;
    scanner style (``fallback_prefix='class_'``) gives ``class_<id>``."""
    m = mapping.select(F.col("id").alias("__id"), F.col("label").alias("__name"))
    j = df.join(m, F.col(id_col) == F.col("__id"), "left")
    name = F.col("__name")
    if fallback_prefix is not None:
        name = F.when(F.col(id_col).isNull(), F.lit(None)).otherwise(
            F.coalesce(name, F.concat(F.lit(fallback_prefix), F.col(id_col).cast("string"))))
    return j.withColumn(out, name).drop("__id", "__name")


def attach_weight(df: DataFrame, label_col: str, weights: DataFrame, out: str = "weight",
                  default: float = 1.0) -> DataFrame:
    """``join_class_weight``: class weight per row, 1.0 when the class has none."""
    w = weights.select(F.col("y").alias("__y"), F.col("weight").alias("__w"))
    return (df.join(w, F.col(label_col) == F.col("__y"), "left")
              .withColumn(out, F.coalesce(F.col("__w"), F.lit(default)).cast("double"))
              .drop("__y", "__w"))


def align_by_key(left: DataFrame, right: DataFrame, key: str = "sha256") -> DataFrame:
    """``join_align_splits``: inner join two label tables of the same split by key.

    Raises when a key exists on one side only (the reference compares row
    counts; a keyed anti-join is the positional check made exact).
    """
    lk = left.select(key).distinct()
    rk = right.select(key).distinct()
    missing = lk.join(rk, key, "left_anti").limit(1).count() + rk.join(lk, key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("binary and family tables are not aligned: some keys exist on one side only")
    return left.join(right, key, "inner")
