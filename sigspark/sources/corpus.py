"""File corpora (``binaryFile``): listing, suffix filter, size cap, error rows.

The listing and the size test need no file content; ``length`` filters are
pushed into the binaryFile scan, so oversized files are never read. Paths
are not collected to the driver: filtering happens on the listing frame.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference): default executable suffixes.
DEFAULT_EXECUTABLE_EXTENSIONS = (".exe", ".dll", ".sys", ".scr", ".ocx", ".com", ".cpl", ".drv", ".efi", ".msi")


def suffix(path: F.Column) -> F.Column:
    """Lower-cased file suffix ('.exe'), empty when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def select_corpus(files: DataFrame, extensions=DEFAULT_EXECUTABLE_EXTENSIONS, max_file_size_mb: float | None = None,
                  path: str = "path", length: str = "length"):
    """``src_corpus`` filter logic on any (path, length, ...) frame.

    Returns (ok, errors): ``ok`` keeps files with an accepted suffix (case
    insensitive) within the size cap; ``errors`` has (path, size, error) for the
    oversized ones. ``extensions`` None or empty accepts every suffix."""
    f = files
    if extensions:
        f = f.where(suffix(F.col(path)).isin([e.lower() for e in extensions]))
    if max_file_size_mb:
        cap = int(max_file_size_mb * 1024 * 1024)
        ok = f.where(F.col(length) <= cap)
        err = f.where(F.col(length) > cap).select(
            F.col(path).alias("path"), F.col(length).alias("size"),
            F.lit(f"skipped: file larger than {max_file_size_mb} MB").alias("error"))
        return ok, err
    return f, None


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True, extensions=DEFAULT_EXECUTABLE_EXTENSIONS,
                max_file_size_mb: float | None = None):
    """(ok DataFrame with content, error rows) for a folder of files."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(folder)
    ok, err = select_corpus(df, extensions, max_file_size_mb)
    empty = ok.where(F.col("length") == 0).select("path", F.col("length").alias("size"),
                                                  F.lit("empty file").alias("error"))
    ok = ok.where(F.col("length") > 0)
    return ok, (err.unionByName(empty) if err is not None else empty)
