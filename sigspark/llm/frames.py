"""Small DataFrame helpers shared by the operators: shared-folder tables and column picking."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.session import scratch_path

#: Reserved prefix of helper columns, so that extra input columns cannot clash with them.
TMP = "__llm_"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string")) % n
