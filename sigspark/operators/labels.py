"""Label layer: label counts, the dense label map, label encoding and multi-hot targets.

All of it is a ``groupBy`` over the labels (partial aggregation before the
shuffle) and lookups against the resulting small map.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import lookup_id

# Fixed values (must equal the reference): tags never used as a class.
IGNORE_TAGS = ["", "win32", "win64", "elf", "linux", "pdf", "apk", "android"]


def label_values(df: DataFrame, label_col: str) -> DataFrame:
    """One row per string label value: arrays are flattened, nulls dropped.

    A VARIANT column keeps string scalars and the string elements of arrays
    only (``agg_label_counts`` counts string values only).
    """
    dt = df.schema[label_col].dataType
    c = F.col(label_col)
    if isinstance(dt, T.ArrayType):
        v = df.select(F.explode(c).alias("label"))
    elif isinstance(dt, T.VariantType):
        arr = F.try_variant_get(c, "$", "array<variant>")
        elems = F.when(arr.isNotNull(), arr).otherwise(F.array(c))
        v = (df.select(F.explode(elems).alias("e"))
               .where(F.schema_of_variant("e") == "STRING")
               .select(F.variant_get("e", "$", "string").alias("label")))
    else:
        v = df.select(c.cast("string").alias("label"))
    return v.where(F.col("label").isNotNull())


def label_counts(df: DataFrame, label_col: str) -> DataFrame:
    """``agg_label_counts``: (label, n)."""
    return label_values(df, label_col).groupBy("label").agg(F.count("*").alias("n"))


def build_label_map(train: DataFrame, label_col: str, class_min: int = 10,
                    ignore: list[str] = IGNORE_TAGS) -> DataFrame:
    """``agg_label_map`` + ``win_dense_label_id``: (label, id, n), ids dense from 0
    by (n desc, label asc) over labels seen >= class_min times in train,
    ignored tags excluded. The window runs over the aggregated map only."""
    counts = label_counts(train, label_col)
    kept = counts.where((~F.col("label").isin(ignore)) & (F.col("n") >= class_min))
    w = Window.orderBy(F.col("n").desc(), F.col("label").asc())
    return kept.select("label", (F.row_number().over(w) - 1).cast("int").alias("id"), "n")


def encode_single_label(df: DataFrame, label_col: str, label_map: DataFrame, out: str = "y") -> DataFrame:
    """``prj_encode_label``: null -> -1, integers pass, strings -> map id or -1."""
    dt = df.schema[label_col].dataType
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return df.withColumn(out, F.coalesce(F.col(label_col).cast("int"), F.lit(-1)))
    return lookup_id(df, label_col, label_map, out=out)


def multihot_long(df: DataFrame, key: str, labels_col: str, label_map: DataFrame) -> DataFrame:
    """Multilabel target as a long table (key, label_id); unknown labels ignored."""
    m = label_map.select(F.col("label").alias("__l"), F.col("id").alias("label_id"))
    ex = df.select(key, F.explode_outer(labels_col).alias("__l"))
    return ex.join(m, "__l", "inner").select(key, "label_id").distinct()


def multihot(df: DataFrame, key: str, labels_col: str, label_map: DataFrame, k: int | None = None,
             out: str = "y_multi") -> DataFrame:
    """``prj_multihot``: K-wide 0/1 array per row (null or unknown labels -> zeros).

    The map is computed once. It has K entries, as many as the array of every single
    output row, so it is shipped to the tasks as a list and rows are not shuffled. Tasks
    look the ids up in Arrow batches; the K-wide arrays are made row by row in the JVM, so
    no batch ever holds rows x K cells.
    """
    rows = [(r["label"], int(r["id"])) for r in label_map.select("label", "id").collect()]
    width = k if k is not None else max((i for _, i in rows), default=-1) + 1
    shared = df.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64)))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def known_ids(labels: pa.Array) -> pa.Array:
        names, ids = shared.value
        values, counts = labels.flatten(), pc.fill_null(pc.list_value_length(labels), 0).to_numpy(zero_copy_only=False)
        at = pc.index_in(values, value_set=pa.array(names, type=values.type))
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        found = ids[at.drop_null().to_numpy(zero_copy_only=False)]
        if len(found) and found.max() >= width:
            raise IndexError(f"label id {found.max()} is out of bounds for width {width}")
        row = np.repeat(np.arange(len(labels), dtype=np.int64), counts)[hit]
        cells = np.unique(row * width + found)                  # each id of a row once, ascending
        offsets = np.searchsorted(cells, np.arange(len(labels) + 1, dtype=np.int64) * width)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells % max(width, 1), pa.int32()))

    with_ids = df.withColumn("__ids", known_ids(F.col(labels_col)))
    return with_ids.withColumn(out, dense_from_ids(F.col("__ids"), width)).drop("__ids")


def dense_from_ids(ids: Column, k: int) -> Column:
    """K-wide 0/1 array from a list of ids, as runs of zeros that each end in a one."""
    s = F.sort_array(F.array_distinct(F.coalesce(ids, F.array().cast("array<int>"))))
    before = F.slice(F.concat(F.array(F.lit(-1)), s), 1, F.size(s))
    runs = F.zip_with(s, before, lambda i, p: F.concat(F.array_repeat(F.lit(0), i - p - 1), F.array(F.lit(1))))
    rest = F.array_repeat(F.lit(0), F.lit(k - 1) - F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(-1)))
    return F.flatten(F.concat(runs, F.array(rest)))


def filter_ignored(df: DataFrame, col: str, ignore: list[str] = IGNORE_TAGS) -> DataFrame:
    """``flt_ignore_tags``."""
    return df.where(~F.col(col).isin(ignore) | F.col(col).isNull())


def read_label(line: Column, label_type: str) -> Column:
    """``prj_read_label``: the label field of one raw JSON line, as VARIANT."""
    return F.try_variant_get(F.try_parse_json(line), f"$.{label_type}", "variant")
