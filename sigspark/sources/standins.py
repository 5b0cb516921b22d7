"""Raw-record stand-ins derived from the driver tables.

The driver tables hold no malware records, so the record-shaped jobs run on
JSON lines that Spark derives from ``documents`` (left-joined to
``labels``): one line per document, with the metadata, label fields and a
few feature blocks of a raw record, mixed value shapes, blank lines and
malformed lines. The same SQL text (with the hash function name swapped)
builds the lines in the DuckDB oracle, so both sides read identical input.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from .tables import table

# {sha} is sha2(x, 256) in Spark and sha256(x) in DuckDB.
RECORD_SQL = """
SELECT d.doc_id,
  CASE WHEN d.lang = 'en' THEN 'train' WHEN d.lang IN ('fr', 'de') THEN 'test' ELSE 'challenge' END AS split,
  concat('2024-01-', lpad(cast(1 + 7 * (d.doc_id % 5) AS STRING), 2, '0'), '_',
         '2024-01-', lpad(cast(7 + 7 * (d.doc_id % 5) AS STRING), 2, '0'), '_',
         CASE WHEN d.lang = 'es' THEN 'Win64' WHEN d.lang = 'de' THEN 'Dot_Net' ELSE 'Win32' END, '_',
         CASE WHEN d.lang = 'en' THEN 'train' WHEN d.lang IN ('fr', 'de') THEN 'test' ELSE 'challenge' END,
         '.jsonl') AS file_name,
  CASE
    WHEN d.doc_id % 50 = 7 THEN '   '
    WHEN d.doc_id % 50 = 13 THEN concat('{"sha256": "', md5(d.text), '", "label": ')
    ELSE concat(
      '{"sha256": "', {sha}, '"',
      ', "md5": "', md5(d.text), '"',
      CASE WHEN l.doc_id IS NULL AND d.doc_id % 2 = 0 THEN ''
           ELSE concat(', "label": ', CASE WHEN d.doc_id % 17 = 3 THEN '-1' ELSE coalesce(cast(l.toxic AS STRING), 'null') END) END,
      CASE WHEN d.doc_id % 9 = 4 THEN '' ELSE concat(', "file_type": "', d.lang, '"') END,
      CASE WHEN d.doc_id % 11 = 5 THEN ''
           ELSE concat(', "week_id": "2024-01-', lpad(cast(1 + 7 * (d.doc_id % 5) AS STRING), 2, '0'), '"') END,
      ', "family": ', CASE WHEN l.toxic = 1 OR d.doc_id % 3 = 0 THEN concat('"', d.source, '"') ELSE 'null' END,
      ', "family_confidence": ', CASE d.doc_id % 4 WHEN 0 THEN '0.875' WHEN 1 THEN '"high"'
                                      WHEN 2 THEN 'null' ELSE '[1, 2]' END,
      ', "detection_ratio": ', CASE d.doc_id % 4 WHEN 0 THEN concat('"', cast(d.n_chars % 61 AS STRING), '/70"')
                                   WHEN 1 THEN cast(d.n_chars % 61 AS STRING)
                                   WHEN 2 THEN '"n/a"' ELSE 'null' END,
      ', "behavior": ', CASE d.doc_id % 5
                          WHEN 0 THEN concat('["', d.lang, '", "', d.source, '", " "]')
                          WHEN 1 THEN concat('"', d.source, '"')
                          WHEN 2 THEN concat('{"', d.lang, '": true, "n": ', cast(d.doc_id % 3 AS STRING),
                                             ', "s": "", "t": "x", "f": false}')
                          WHEN 3 THEN '[]' ELSE 'null' END,
      ', "packer": ', CASE WHEN d.doc_id % 6 = 0 THEN concat('["', d.source, '", ["', d.lang, '"]]')
                           WHEN d.doc_id % 6 = 1 THEN cast(d.doc_id % 4 AS STRING)
                           ELSE '""' END,
      ', "group": ', CASE WHEN d.doc_id % 2 = 0 THEN concat('["', d.lang, '"]') ELSE 'null' END,
      ', "general": {"size": ', cast(d.n_chars AS STRING),
        ', "entropy": ', cast(4 + CAST(((d.n_chars % 400) - (d.n_chars % 100)) / 100 AS BIGINT) AS STRING),
                         '.', lpad(cast(d.n_chars % 100 AS STRING), 2, '0'),
        ', "is_pe": ', CASE WHEN d.lang = 'en' THEN '1' ELSE '0' END, '}',
      ', "strings": ', CASE WHEN d.doc_id % 8 = 3 THEN '{}'
                            ELSE concat('{"numstrings": ', cast(length(d.text) - length(replace(d.text, '.', '')) AS STRING),
                                        ', "avlength": ', cast(d.n_chars % 97 AS STRING), '.',
                                        lpad(cast(d.n_chars % 1000 AS STRING), 3, '0'),
                                        ', "printables": ', cast(d.n_chars AS STRING), '}') END,
      ', "histogram": ', CASE WHEN d.doc_id % 10 = 1 THEN '[]' ELSE '[1, 2, 3]' END,
      ', "header": ', CASE WHEN d.lang = 'en' THEN '{"coff": {"timestamp": 1}}' ELSE '{}' END,
      ', "imports": ', CASE WHEN d.lang = 'en' THEN '{"kernel32.dll": ["CreateFileA"]}' ELSE '{}' END,
      ', "exports": []',
      '}')
  END AS value
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def record_sql(engine: str = "spark") -> str:
    sha = "sha2(d.text, 256)" if engine == "spark" else "sha256(d.text)"
    return RECORD_SQL.replace("{sha}", sha)


def register_tables(spark: SparkSession, sf: str, names=("documents", "labels")) -> None:
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)


def landed_lines(spark: SparkSession, sf: str) -> str:
    """Folder of JSONL files written from the stand-in lines, in the layout of the raw corpus."""
    from .jsonl import write_lines
    folder = scratch_path(spark, f"raw-{uuid.uuid4().hex[:12]}")
    write_lines(raw_record_lines(spark, sf), folder, "doc_id")
    return folder


def raw_record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, split, file_name, value): one JSON line per document."""
    register_tables(spark, sf)
    return spark.sql(record_sql("spark"))
