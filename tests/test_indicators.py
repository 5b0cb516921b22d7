"""String indicators: cheap tests before a pattern lose no match; a pattern under two names is counted once."""
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sigspark.functions import strings as fs

TEXTS = ["http://a.b/c", "see ftp://x and https://y", "http:/ no", "10.0.0.1", "v1.2.3 and 256.1.1.1", "1.2.3.4.5", "999.10.10.10", "a.10.b.1.c",
         "1:2:3:4:5:6:7:8", "fe80::", "fe80::1 x", " :a:b:c", "x::y", "::", "a:b", "00:1A:2b:3C:4d:5E", "00-1A-2b-3C-4d-5E", "00:1A-2b:3C-4d:5E", "0:1A:2b:3C:4d:5E", "00:1A:2b:3C:4d",
         "C:/dir", "xC:/dir", "c:/dir", "KHEY_A", "KHLM", "aHKCU", "HKCU ", "HKLM", "a.click(", "xClIcKed", "click first", "click", " click",
         "1" + "a" * 25, "3" + "Z" * 34, "1" + "a" * 24, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/",
         "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz01234567899/",
         "!This program cannot", "GET / HTTP/1.1", "plain words only", "PowerShell Cookie"]


def _want(strings):
    return {n: sum(bool(re.search(p, s, re.ASCII | (re.IGNORECASE if ci else 0))) for s in strings) for n, p, ci in fs.IOC_PATTERNS}


def test_cheap_tests_lose_no_match(spark):
    rows = [(i, [t]) for i, t in enumerate(TEXTS)] + [(len(TEXTS), TEXTS), (len(TEXTS) + 1, [])]
    got = spark.createDataFrame(rows, "id int, s array<string>").select("id", fs.ioc_counts(F.col("s")).alias("c")).collect()
    for r in got:
        assert r.c.asDict() == _want(rows[r.id][1]), rows[r.id][1]
    files = spark.createDataFrame([(bytearray("\n".join(TEXTS), "ascii"),), (None,)], "content binary")
    full, empty = [r.c for r in fs.with_ioc_counts(files, "content", "c").collect()]
    assert full.asDict() == _want([t for t in TEXTS if len(t) >= 5])
    assert set(empty.asDict().values()) <= {None, -1}


def test_repeated_pattern_is_counted_once(spark):
    files = spark.createDataFrame([(bytearray(b"00:1A:2b:3C:4d:5E"),)], "content binary")
    df = fs.with_ioc_counts(files, "content", "c")
    mac = next(p for n, p, _ in fs.IOC_PATTERNS if n == "mac_addr")
    assert df._jdf.queryExecution().optimizedPlan().toString().count(mac) == 1
    assert (df.first().c["mac_addr"], df.first().c["email_addr"]) == (1, 1)


def test_file_vectors_are_written_as_columns(spark, sf_small):
    df = entry.queries()["ml_predict_file"](spark, sf_small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "ExistingRDD" not in plan
    assert "file-vectors-" in ",".join(df.inputFiles())
