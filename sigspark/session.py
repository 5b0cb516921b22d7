"""Session helpers.

Cluster settings (shuffle partitions, checkpoint directory, memory) come from
the submitting environment. ``get_session`` only fills in values that are not
set yet, so the same code runs in tests (local mode) and on a cluster.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults applied only when the key is not already configured.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # local runs only: the driver JVM is the executor; a cluster sets its own
    "spark.driver.memory": "12g",
}


def get_session(master: str | None = None, app_name: str = "sigspark",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        if k == "spark.driver.memory" and not (master or "").startswith("local"):
            continue
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only a local master may leave
    it unset (tests): a private scratch folder is then created and kept by the Spark context,
    since a running session does not accept the key.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    registered = context.getCheckpointDir()
    if configured:
        if registered is None:
            context.setCheckpointDir(configured)
        return configured
    if registered is None:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local") or "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sigspark-ckpt-"))
        registered = context.getCheckpointDir()
    return registered


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    return os.path.join(checkpoint_dir(spark), name)


def materialise(df, name: str):
    """The rows written once to the shared folder and read back: computed once, whatever branches from them."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
