"""Featurisation jobs: raw records -> fixed-width vectors.

``vectorize_records`` is the main path (the dataset ships raw JSONL records):
parse with the explicit schema, map each block to its vector slice, concat.
``raw_from_bytes`` builds the byte-derived blocks (general, histogram,
byte/entropy histogram, strings) from file content, for corpora of raw
files; PE-only blocks stay empty there (no PE parser is built). Both are one
narrow stage: no shuffle, one pass over the input.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as fb
from ..functions import pe
from ..functions import strings as fs


def add_raw_from_bytes(df: DataFrame, content: str = "content", out: str = "raw_bytes",
                       with_byte_entropy: bool = True) -> DataFrame:
    """Adds the raw struct of the byte-derived blocks (RAW_SCHEMA field names).

    The Arrow UDF outputs are materialised as columns first: Spark does not
    allow a Python UDF inside the higher-order functions used later."""
    c = F.col(content)
    d = (df.withColumn("__hist", fb.byte_histogram_udf(c))
           .withColumn("__ps", fb.printable_stats_udf(c))
           )
    # indicator counts as their own column: the map built from them is read 77 times
    d = fs.with_ioc_counts(d, content, "__ioc")
    if with_byte_entropy:
        d = d.withColumn("__be", fb.byte_entropy_histogram_udf(c))
    hist, ps = F.col("__hist"), F.col("__ps")
    raw = F.struct(
        F.sha2(c, 256).alias("sha256"),
        fb.general_block(c, hist).alias("general"),
        hist.alias("histogram"),
        (F.col("__be") if with_byte_entropy else F.lit(None).cast("array<bigint>")).alias("byteentropy"),
        F.struct(ps["numstrings"].alias("numstrings"), ps["avlength"].alias("avlength"),
                 ps["printabledist"].cast("array<double>").alias("printabledist"), ps["printables"].alias("printables"),
                 ps["entropy"].alias("entropy"), fs.count_map(F.col("__ioc")).alias("string_counts")).alias("strings"))
    return d.withColumn(out, raw).drop("__hist", "__ps", "__be", "__ioc")


def vectorize_records(df: DataFrame, raw: str = "raw", blocks: list[str] | None = None, mode: str = "murmur",
                      out: str = "features") -> DataFrame:
    """``ft_assemble`` over a parsed raw-record column -> ARRAY<FLOAT> of the chosen blocks."""
    return pe.assemble(df, raw, blocks, mode, out)


def vectorize_lines(lines: DataFrame, value: str = "value", blocks: list[str] | None = None,
                    mode: str = "murmur") -> DataFrame:
    """JSONL lines -> (sha256, label, family, features); malformed lines are dropped."""
    parsed = lines.withColumn("raw", pe.parse_raw(F.col(value))).where(F.col("raw").isNotNull())
    v = vectorize_records(parsed, "raw", blocks, mode)
    return v.select(F.col("raw.sha256").alias("sha256"), F.col("raw.label").alias("label"),
                    F.col("raw.family").alias("family"), "features", *[c for c in lines.columns if c != value])


def vectorize_bytes_and_record(spark: SparkSession, sf: str, mode: str = "murmur") -> DataFrame:
    """Stand-in full vectors: byte blocks from ``encode(documents.text)`` and the PE
    blocks from the document-derived record. The PE record goes through its JSON
    text and ``RAW_SCHEMA`` (the path of a real JSONL corpus); building the
    struct inline would let the optimizer re-inline the text transforms into
    every one of the ~1900 slot expressions."""
    from ..sources.pe_standin import raw_struct, with_parts
    from ..sources.tables import table
    d = table(spark, sf, "documents")
    d = with_parts(d).select("doc_id", "source", "lang", F.encode("text", "UTF-8").alias("content"),
                             F.to_json(raw_struct()).alias("pe_json"))
    d = add_raw_from_bytes(d, "content", "b").withColumn("r", pe.parse_raw(F.col("pe_json")))
    b, r = F.col("b"), F.col("r")
    merged = F.struct(b["general"].alias("general"), b["histogram"].alias("histogram"),
                      b["byteentropy"].alias("byteentropy"), b["strings"].alias("strings"),
                      r["header"].alias("header"), r["section"].alias("section"), r["imports"].alias("imports"),
                      r["exports"].alias("exports"), r["datadirectories"].alias("datadirectories"),
                      r["richheader"].alias("richheader"), r["authenticode"].alias("authenticode"),
                      r["pefilewarnings"].alias("pefilewarnings"))
    rec = d.select("doc_id", "source", "lang", merged.alias("raw"))
    return vectorize_records(rec, "raw", None, mode)
