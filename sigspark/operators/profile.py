"""Per-file byte profile: the raw ``general``, ``histogram``, ``byteentropy`` and
``strings`` blocks computed from a ``content BINARY`` column.

One narrow stage, no shuffle: every column is a JVM expression except the
three Arrow UDFs, which each read the content once per Arrow batch.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as fb
from ..functions import strings as fs


def byte_profile(df: DataFrame, content: str = "content", with_iocs: bool = False,
                 with_byte_entropy: bool = False) -> DataFrame:
    c = F.col(content)
    out = (df
           .withColumn("sha256", F.sha2(c, 256))
           .withColumn("histogram", fb.byte_histogram_udf(c))
           .withColumn("general", fb.general_block(c, F.col("histogram")))
           .withColumn("pstats", fb.printable_stats_udf(c)))
    if with_byte_entropy:
        out = out.withColumn("byteentropy", fb.byte_entropy_histogram_udf(c))
    if with_iocs:
        out = fs.with_ioc_counts(out, content, "__ioc")
        out = out.withColumn("string_counts", fs.count_map(F.col("__ioc"))).drop("__ioc")
    return out


def strings_block(pstats: str = "pstats", string_counts: str | None = "string_counts"):
    """``strings`` raw struct from the printable stats and indicator counts."""
    p = F.col(pstats)
    fields = [p["numstrings"].alias("numstrings"), p["avlength"].alias("avlength"),
              p["printabledist"].alias("printabledist"), p["printables"].alias("printables"),
              p["entropy"].alias("entropy")]
    if string_counts:
        fields.append(F.col(string_counts).alias("string_counts"))
    return F.struct(*fields)
