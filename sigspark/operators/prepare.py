"""The prepare job: raw JSONL records -> one feature table and label tables that join it without a shuffle.

``prepare`` reads the selected files of every subset, turns each record into its
feature vector and writes three tables, all bucketed and sorted by ``row_id``:

* ``features``: row_id, subset, sha256, label, family, features
* ``binary``: row_id, subset, y (0 / 1, -1 where unlabelled)
* ``family``: row_id, subset, y (id in the label map, -1 where unknown)

``row_id`` numbers records, since copies of a file repeat its sha256 and a third of
all rows may be copies. The label tables are derived from the narrow columns of the
written feature table, so records are parsed once and ids agree. The label map counts
the families of the training subset. A manifest (one JSON line for each table) lets
any later session open the tables again with their bucketing: ``open_table``.

``read_vectors`` joins features and labels of a subset bucket by bucket and checks
width and labels while reading: the counts come from ``DataFrame.observe`` with
the rows, not from a pass of their own.

Malformed lines are left out and counted in the manifest; null sha256, label or
family stay null or become -1; an empty selection of files raises.
"""
from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import pe
from ..sources.jsonl import gather_feature_paths, read_lines
from . import labels as lb
from .featurize import vectorize_records

TABLES = ("features", "binary", "family")
KEY = "row_id"
MANIFEST_SCHEMA = ("name string, path string, table string, key string, buckets int, columns string, n_rows bigint, "
                   "width int, n_bad bigint, class_min int")


@dataclass(frozen=True)
class Prepared:
    """Folder and manifest of a prepared dataset."""
    folder: str
    tables: dict[str, dict]

    @property
    def width(self) -> int:
        return int(self.tables["features"]["width"])


def _write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    df.write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(table)


def prepare(spark: SparkSession, data_dir: str, out_dir: str, subsets: tuple[str, ...] = ("train", "test", "challenge"),
            class_min: int = 10, buckets: int | None = None, blocks: list[str] | None = None, mode: str = "murmur",
            pattern: str = "*.jsonl", recursive: bool = False) -> Prepared:
    """``sink_vectors`` and ``sink_project_layout``: writes the three tables, the label map and the manifest."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = None
    for s in subsets:
        lines = read_lines(spark, gather_feature_paths(spark, data_dir, s, pattern=pattern, recursive=recursive)).select("value", F.lit(s).alias("subset"))
        read = lines if read is None else read.unionByName(lines)
    seen = Observation()
    parsed = (read.withColumn(KEY, F.monotonically_increasing_id())
              .observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("value").isNull()).alias("bad"))
              .where(F.try_parse_json("value").isNotNull())
              .repartition(buckets, KEY)                       # one file for each bucket
              .withColumn("raw", pe.parse_raw(F.col("value"))))
    vectors = vectorize_records(parsed, "raw", blocks, mode)
    tag = uuid.uuid4().hex[:12]
    names = {t: f"prepared_{tag}_{t}" for t in TABLES}
    paths = {t: os.path.join(out_dir, t) for t in TABLES}
    _write_bucketed(vectors.select(KEY, "subset", F.col("raw.sha256").alias("sha256"), F.col("raw.label").alias("label"),
                                   F.col("raw.family").alias("family"), "features"),
                    names["features"], paths["features"], buckets)
    rows = spark.table(names["features"])
    known = rows.select(KEY, "subset", "label", "family")
    label_map = lb.build_label_map(known.where(F.col("subset") == subsets[0]), "family", class_min)
    map_path = os.path.join(out_dir, "label_map")
    label_map.write.json(map_path)
    label_map = spark.read.schema("label string, id int, n bigint").json(map_path)
    _write_bucketed(known.select(KEY, "subset", F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("y")),
                    names["binary"], paths["binary"], buckets)
    family = lb.encode_single_label(known, "family", label_map, out="y").select(KEY, "subset", "y")
    _write_bucketed(family, names["family"], paths["family"], buckets)
    width = sum(d for b, d in pe.BLOCK_DIMS if blocks is None or b in blocks)
    kept, bad = int(seen.get["n"] - seen.get["bad"]), int(seen.get["bad"])
    manifest = [(t, paths[t], names[t], KEY, buckets, spark.table(names[t]).schema.simpleString()[7:-1], kept, width, bad, class_min)
                for t in TABLES]
    spark.createDataFrame(manifest, MANIFEST_SCHEMA).coalesce(1).write.json(os.path.join(out_dir, "manifest"))
    return load_prepared(spark, out_dir)


def load_prepared(spark: SparkSession, folder: str) -> Prepared:
    rows = spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(folder, "manifest")).collect()   # one row for each table
    return Prepared(folder, {r["name"]: r.asDict() for r in rows})


def open_table(spark: SparkSession, prepared: Prepared, name: str) -> DataFrame:
    """A table of the dataset with its bucketing, declared again in sessions that do not know it."""
    t = prepared.tables[name]
    if not spark.catalog.tableExists(t["table"]):
        columns = ", ".join(c.replace(":", " ", 1) for c in _top_level(t["columns"]))
        spark.sql(f"CREATE TABLE {t['table']} ({columns}) USING parquet CLUSTERED BY ({t['key']}) SORTED BY ({t['key']}) "
                  f"INTO {t['buckets']} BUCKETS LOCATION '{t['path']}'")
    return spark.table(t["table"])


def _top_level(columns: str) -> list[str]:
    """The column declarations of a schema string; commas inside nested types do not part them."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


class VectorCheck:
    """Counts gathered while vectors are read; ``verify`` raises on the faults of the rows that an action has read."""

    def __init__(self, width: int):
        self.width, self.seen = width, Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen, F.count(F.lit(1)).alias("n"),
                          F.count_if(F.coalesce(F.size("features") != self.width, F.lit(True))).alias("odd_width"),
                          F.count_if(F.col("y").isNull()).alias("no_label"))

    def verify(self) -> dict:
        got = self.seen.get
        if got["odd_width"]:
            raise ValueError(f"{got['odd_width']} of {got['n']} vectors are not {self.width} wide")
        if got["no_label"]:
            raise ValueError(f"{got['no_label']} of {got['n']} vectors have no row in the label table")
        return got


def read_vectors(spark: SparkSession, prepared: Prepared, subset: str | None = None, target: str = "binary") -> tuple[DataFrame, VectorCheck]:
    """``src_vectors``: (rows with ``y`` and ``features``, check). After an action on the rows, ``check.verify()``
    raises if a vector has another width than the manifest states or a label is missing."""
    features, y = open_table(spark, prepared, "features"), open_table(spark, prepared, target).select(KEY, "y")
    if subset is not None:
        features = features.where(F.col("subset") == subset)
    check = VectorCheck(prepared.width)
    return check.watch(features.join(y, KEY, "left")), check
