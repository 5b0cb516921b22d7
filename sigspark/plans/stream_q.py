"""Registered streaming and UDTF queries (streams drained with availableNow)."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import udtf
from ..session import scratch_path
from ..sources.tables import table
from ..streaming import jobs


#: Files that the folder scan lands; a bounded number, whatever the corpus.
LANDING_FILES = 64


def q_stm_week_counts(spark, sf):
    return jobs.drain(spark, jobs.week_counts(jobs.read_stream_table(spark, sf, "events")),
                      ["week_start", "event_type"])


def q_stm_label_counts(spark, sf):
    return jobs.drain(spark, jobs.label_counts(jobs.read_stream_table(spark, sf, "documents"), "source"), ["label"])


def q_stm_scan_folder(spark, sf):
    """Documents land as ``LANDING_FILES`` text files in a scratch folder; the stream scores them."""
    from ..functions import bytes as fb
    from ..operators import cascade as cs
    from ..operators import labels as lb

    folder = scratch_path(spark, f"landing-{uuid.uuid4().hex[:12]}")
    bucket = F.pmod(F.col("doc_id"), F.lit(LANDING_FILES)).alias("bucket")
    table(spark, sf, "documents").select(bucket, "text").repartition("bucket").write.partitionBy("bucket").text(folder)
    fmap = lb.build_label_map(table(spark, sf, "documents"), "source", class_min=1)

    def batch_scan(batch):
        feats = (batch.withColumn("hist", fb.byte_histogram_udf(F.col("content")))
                 .select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"),
                         (fb.is_pe_guess(F.col("content")) == 1).alias("is_pe"),
                         fb.entropy_from_counts(F.col("hist")).alias("entropy"), "hist"))
        l1 = lambda df: df.withColumn("malware_score", F.col("entropy") / 8.0)
        tot = F.aggregate("hist", F.lit(0).cast("bigint"), lambda a, x: a + x)
        l2 = lambda df: df.withColumn("family_scores", F.array(*[(F.col("hist")[b] / tot) for b in (0x65, 0x20, 0x61, 0x74)]))
        return cs.scan_results(feats, l1, 0.55, l2, fmap, F.sequence(F.lit(0), F.lit(3)))

    out = scratch_path(spark, f"scan-out-{uuid.uuid4().hex[:12]}")
    q = jobs.scan_stream(spark, folder, out, batch_scan, glob="*.txt", max_files_per_trigger=200)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    res = spark.read.parquet(out)
    return res.agg(F.count("*").alias("n_files"), F.count_if("is_malware").alias("n_malware"),
                   F.countDistinct("batch_id").alias("n_batches"))


def q_udtf_windows(spark, sf):
    udtf.register(spark)
    table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).createOrReplaceTempView("pages_bytes")
    return spark.sql("SELECT p.page_id, w.start, w.length, w.hbin FROM pages_bytes p, LATERAL byte_windows(p.content) w")


QUERIES = {
    "stm_week_counts": q_stm_week_counts,
    "stm_label_counts": q_stm_label_counts,
    "stm_scan_folder": q_stm_scan_folder,
    "udtf_windows": q_udtf_windows,
}

ORACLE = {
    "stm_week_counts": """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL""",
    "stm_label_counts": "SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "udtf_windows": """
WITH b AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages WHERE octet_length(encode(html)) > 0),
w AS (SELECT page_id, n, unnest(CASE WHEN n < 2048 THEN [0] ELSE range(0, n - 2048 + 1, 1024) END) AS start FROM b)
SELECT w.page_id, w.start, CASE WHEN w.n < 2048 THEN w.n ELSE 2048 END AS length, e.hbin FROM w
JOIN (
  WITH bb AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages),
  nb AS (SELECT page_id, i, ('0x' || substr(h, 2*i+1, 1))::INTEGER AS nib FROM bb, range(n) t(i)),
  ww AS (SELECT page_id, unnest(CASE WHEN n < 2048 THEN [0] ELSE range(0, n - 2048 + 1, 1024) END) AS ws FROM bb),
  cand AS (SELECT page_id, nib, unnest([(i // 1024) * 1024, (i // 1024) * 1024 - 1024]) AS ws FROM nb),
  cnt AS (SELECT cand.page_id, cand.ws, nib, count(*) AS c FROM cand JOIN ww ON cand.page_id = ww.page_id AND cand.ws = ww.ws GROUP BY ALL),
  ent AS (SELECT page_id, ws, -sum(CAST(c AS FLOAT) / 2048.0 * log2(CAST(c AS FLOAT) / 2048.0)) * 2 AS hh FROM cnt GROUP BY ALL)
  SELECT page_id, ws, CAST(least(floor(hh * 2), 15) AS INTEGER) AS hbin FROM ent
) e ON e.page_id = w.page_id AND e.ws = w.start""",
}
