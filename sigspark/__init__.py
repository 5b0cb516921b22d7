"""sigspark: static file-analysis analytics expressed as Spark DataFrame jobs.

Sub-packages:
  sources    readers and writers (JSONL records, file corpora, vectors, reports)
  functions  column expressions and Arrow UDFs (JSON helpers, byte/string features, hashing)
  operators  DataFrame operators (labels, audit, coverage, metrics, splits, ML, cascade)
  plans      the registered queries over the driver tables and their SQL oracles
  streaming  Structured Streaming jobs (folder scan, weekly counts, running label counts)
"""

__version__ = "0.1.0"
