"""JSONL raw-record sources: file selection, line reading, row counts, metadata.

Files are read with ``spark.read.text`` (splittable, one task per block) and
every row carries its file through the hidden ``_metadata`` column, so the
per-file and per-split reports are plain aggregations.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonval as jv
from ..operators.audit import EXPECTED_SPLITS, parse_filename, split_from_path

# Fixed values (must equal the reference): metadata columns in their order.
ORDERED_COLUMNS = ["sha256", "tlsh", "first_submission_date", "last_analysis_date", "detection_ratio",
                   "label", "file_type", "family", "family_confidence", "behavior", "file_property",
                   "packer", "exploit", "group"]

# Fixed values (must equal the reference): download selectors and their expansion.
VALID_SPLITS = ["all", "train", "test", "challenge"]
VALID_FILES = ["all", "PE", "Win32", "Win64", "Dot_Net", "APK", "ELF", "PDF"]


def file_type_group(file_type: str) -> list[str]:
    """``flt_file_type_group``: PE -> Win32/Win64/Dot_Net, all -> the six types."""
    if file_type not in VALID_FILES:
        raise ValueError(f"unknown file type {file_type!r}; known: {VALID_FILES}")
    if file_type == "PE":
        return ["Win32", "Win64", "Dot_Net"]
    if file_type == "all":
        return VALID_FILES[2:]
    return [file_type]


def split_group(split: str) -> list[str]:
    if split not in VALID_SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {VALID_SPLITS}")
    return VALID_SPLITS[1:] if split == "all" else [split]


def list_files(spark: SparkSession, data_dir: str, pattern: str = "*.jsonl", recursive: bool = False) -> DataFrame:
    """File listing (path, file_name, length, modificationTime) without reading content."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(data_dir).select("path", "length", "modificationTime")
    return df.withColumn("file_name", file_name_of(F.col("path")))


def file_name_of(path: F.Column) -> F.Column:
    """Name of the ``.jsonl`` file in a path: the file itself, or the folder that Spark wrote its parts to."""
    name = F.regexp_extract(path, r"([^/=]+\.jsonl)(/|$)", 1)
    return F.when(name != "", name).otherwise(F.element_at(F.split(path, "/"), -1))


def write_lines(lines: DataFrame, folder: str, order_by: str | None = None) -> None:
    """Raw lines (split, file_name, value) as JSONL under ``folder/<split>/``, one part for each file."""
    for split in EXPECTED_SPLITS:
        part = lines.where(F.col("split") == split).repartition("file_name")
        part = part.sortWithinPartitions("file_name", order_by) if order_by else part
        part.select(F.col("file_name").alias("file"), "value").write.partitionBy("file").text(f"{folder}/{split}")


def select_files(files: DataFrame, subset: str, filetype: str | None = None, week: str | None = None) -> DataFrame:
    """``src_select_files``: substring match of subset / file type / week on the file name."""
    cond = F.col("file_name").contains(subset)
    if filetype is not None:
        cond &= F.col("file_name").contains(filetype)
    if week is not None:
        cond &= F.col("file_name").contains(week)
    return files.where(cond)


def gather_feature_paths(spark: SparkSession, data_dir: str, subset: str, filetype: str | None = None,
                         week: str | None = None, pattern: str = "*.jsonl", recursive: bool = False) -> list[str]:
    """Sorted list of matching file paths (the listing is metadata, one entry per file);
    raises when nothing matches."""
    sel = select_files(list_files(spark, data_dir, pattern, recursive), subset, filetype, week).orderBy("path")
    paths = [r.path for r in sel.select("path").collect()]
    if not paths:
        raise ValueError(f"no file under {data_dir} has subset {subset!r}, type {filetype!r} and week {week!r} in its name")
    return paths


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``src_jsonl``: non-blank lines with their file path / name, split and ``line_id``.

    ``line_id`` rises with the place in the file and is stable as long as the files are."""
    df = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("line_id"), "value")
    return (df.where(F.col("value").rlike(r"\S"))
              .withColumn("file_name", file_name_of(F.col("file_path")))
              .withColumn("split", split_from_path(F.col("file_path"))))


def row_counts(lines: DataFrame) -> DataFrame:
    """``src_rowcount``: records per file (non-blank lines, so it agrees with the reader)."""
    return lines.groupBy("file_name").agg(F.count("*").alias("n_rows"))


def file_index(files: DataFrame) -> DataFrame:
    """``src_file_index``: path, split, size and the file-name fields, sorted."""
    fn = parse_filename(F.col("file_name"))
    return (files.select("path", "file_name", split_from_path(F.col("path")).alias("split"),
                         F.col("length").alias("size_bytes"), fn["week_start"].alias("week_start"),
                         fn["week_end"].alias("week_end"), fn["file_type_from_name"].alias("file_type_from_name"),
                         fn["valid_name_pattern"].alias("valid_name_pattern"))
                 .orderBy("split", "week_start", "file_type_from_name", "file_name"))


def capped_scan(lines: DataFrame, max_files_per_split: int | None, max_lines_per_file: int | None,
                order_col: str = "line_id") -> DataFrame:
    """``src_capped_scan`` (the FAST_MODE sampling switch): first files per split by
    name, first lines per file. A no-op when both caps are None."""
    from pyspark.sql import Window
    out = lines
    if max_files_per_split is not None:
        files = lines.select("split", "file_name").distinct()
        w = Window.partitionBy("split").orderBy("file_name")
        keep = files.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_files_per_split)
        out = out.join(keep.select("split", "file_name"), ["split", "file_name"], "left_semi")
    if max_lines_per_file is not None:
        w = Window.partitionBy("file_name").orderBy(order_col)
        out = out.withColumn("__l", F.row_number().over(w)).where(F.col("__l") <= max_lines_per_file).drop("__l")
    return out


def metadata(lines: DataFrame, subset_col: str = "split") -> DataFrame:
    """``src_metadata``: the metadata columns of each record plus ``subset``.

    Scalars come out typed (label as INT, text fields as STRING); mixed or
    nested values (detection ratio, list labels, confidence) keep their JSON
    text, taken from the raw line so key order is preserved. Malformed lines have no
    metadata; ``audit.bad_rows`` counts them.
    """
    rec = F.try_parse_json("value")
    lines = lines.where(rec.isNotNull())
    raw = F.from_json("value", "map<string,string>")
    ints = {"label"}
    texts = {"sha256", "tlsh", "first_submission_date", "last_analysis_date", "file_type", "family"}
    cols = []
    for c in ORDERED_COLUMNS:
        v = jv.nested_get(rec, c)
        if c in ints:
            cols.append(F.try_variant_get(v, "$", "int").alias(c))
        elif c in texts:
            cols.append(jv.as_string(v).alias(c))
        else:
            cols.append(raw[c].alias(c))
    return lines.select(*cols, F.col(subset_col).alias("subset"))


def union_splits(frames: list[DataFrame]) -> DataFrame:
    """``set_union_splits``: diagonal union, missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


__all__ = ["EXPECTED_SPLITS", "file_name_of", "write_lines", "ORDERED_COLUMNS", "file_type_group", "split_group", "list_files", "select_files",
           "gather_feature_paths", "read_lines", "row_counts", "file_index", "capped_scan", "metadata", "union_splits"]
