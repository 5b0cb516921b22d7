"""Structured Streaming jobs.

* ``week_counts``: records per 7-day tumbling window (weeks start on Monday:
  epoch windows start on Thursday, hence the 4-day offset) and type, with a
  watermark for late rows.
* ``label_counts``: running label counts.
* ``scan_stream``: score files as they land in a folder; each micro-batch is
  the batch scan job, written idempotently per batch id.

Checkpoints live under the shared checkpoint folder (``spark.checkpoint.dir``).
``drain`` runs a query with the ``availableNow`` trigger and waits for it.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """One driver table, a file or a folder of files, as a file stream (schema taken from the batch reader)."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # as a pattern: a plain path would have to be a folder
    return r.parquet(os.path.join(sf_dir, f"{{{name}}}.parquet"))


def week_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", watermark: str = "7 days") -> DataFrame:
    """``stm_week_counts``: (week_start, kind, n) over 7-day windows starting Monday."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    w = F.window("__ts", "7 days", "7 days", "4 days")
    return (e.groupBy(w.alias("w"), F.col(kind).alias(kind)).agg(F.count("*").alias("n"))
             .select(F.date_format("w.start", "yyyy-MM-dd").alias("week_start"), kind, "n"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """``stm_label_counts``: running count per label value."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def drain(spark: SparkSession, df: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Run a streaming aggregate to completion (availableNow) in update mode and return its last state.

    Every micro-batch writes the groups it changed to its own folder under the shared
    checkpoint folder (a retried batch replaces its output); the result is each group's
    value of the latest batch. State that the watermark has passed is dropped, and so
    are rows that come later than it allows.
    """
    run = uuid.uuid4().hex[:12]
    out = scratch_path(spark, f"stream-out-{run}")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "batch_id long"])

    kept = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        kept.append(batch_id)
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (df.writeStream.outputMode("update").foreachBatch(keep)
           .option("checkpointLocation", scratch_path(spark, f"stream-ckpt-{run}"))
           .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if not kept:                                   # no file or no row came
        return spark.createDataFrame([], schema).drop("batch_id")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value)).select(*df.columns)


def scan_stream(spark: SparkSession, folder: str, out_path: str, batch_scan: Callable[[DataFrame], DataFrame],
                glob: str = "*", max_files_per_trigger: int = 100, available_now: bool = True):
    """``stm_scan_folder``: binaryFile stream -> batch scan per micro-batch -> parquet,
    partitioned by batch id and overwritten per batch (a retried batch replaces
    its own output)."""
    src = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files_per_trigger).load(folder))

    def per_batch(batch: DataFrame, batch_id: int):
        res = batch_scan(batch).withColumn("batch_id", F.lit(batch_id))
        res.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path)

    w = (src.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", scratch_path(spark, f"scan-ckpt-{uuid.uuid4().hex[:12]}")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
