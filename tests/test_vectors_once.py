"""Costly parts of the feature blocks are evaluated once a token or text, and Python tasks work in bounded pieces."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sigspark.functions import hashing as hs
from sigspark.sources import pe_standin as ps


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_md5_hashing_once_a_token(spark):
    toks = [("alpha", 1.5), ("beta", -2.0), ("alpha", 0.25), (None, 3.0), ("", 4.0), *[(f"t{i}", float(i)) for i in range(50)]]
    df = spark.createDataFrame([(toks,), ([],), (None,)], "p array<struct<k:string,v:double>>")
    for n in (8, 10, 32, 50, 128):
        out = df.select(hs.feature_hash_sql(F.col("p"), n, True).alias("x"))
        assert _plan(out).count("md5(") == 1
        want = np.zeros(n)
        for k, v in toks:
            if k is not None:
                u = int(hashlib.md5(k.encode()).hexdigest()[:8], 16)
                h = u - 2 ** 32 if u >= 2 ** 31 else u
                want[abs(h) % n] += v if h >= 0 else -v
        a, b, c = [r["x"] for r in out.collect()]
        assert np.allclose(a, want.astype(np.float32), atol=0) and b == [0.0] * n and c is None


def test_texts_are_split_once(spark, sf_small):
    for name in ("ft_rich_vec", "ft_exports_vec", "ft_authenticode_vec", "ft_section_stats"):
        plan = _plan(entry.queries()[name](spark, sf_small))
        assert plan.count("split(lower(") == 1 and plan.count("from_json(") == 1
    r = spark.createDataFrame([(3, "Banana apple axe. bee Zoo", "en", "s", 25), (4, "x", "de", "s", 1)],
                              "doc_id long, text string, lang string, source string, n_chars long")
    a, b = ps.with_parts(r).select(ps.raw_struct().alias("r")).select("r.imports", "r.exports", "r.richheader").collect()
    assert a["imports"] == {"A.DLL": ["apple", "axe"], "B.DLL": ["banana", "bee"], "z.dll": ["zoo"]}
    assert a["richheader"] == [6, 5, 3, 3, 3] and b["imports"] == {}


def test_python_tasks_work_in_bounded_pieces():
    import pyarrow as pa
    seen = []
    rows = [["a", None, "b"], None, [], *[["x"] * 3] * 1000]
    out = hs.in_pieces(pa.array(rows), 4, lambda r: (seen.append(len(r)), hs.hash_rows(hs._string_rows(r), 4, False))[1])
    assert max(seen) <= hs.PIECE_ROWS and sum(seen) == len(rows)
    assert np.array_equal(np.array(out.to_pylist()), hs.hash_rows(hs._string_rows(rows), 4, False))
