import numpy as np
from pyspark.sql import functions as F

from sigspark.functions import hashing as hs
from sigspark.functions import pe
from sigspark.functions.warnings import normalize_warning
from sigspark.sources.pe_standin import pe_records


def test_python_and_jvm_token_rules_agree(spark, sf_small):
    r = pe_records(spark, sf_small).where("raw.section IS NOT NULL").limit(20)
    raw = F.col("raw")
    specs = [(b, spec) for b in ["section", "imports", "exports", "richheader"] for spec in pe.HASH_INPUTS[b](raw)]
    jvm = r.select("raw", *[s[1].alias(f"t{i}") for i, (_, s) in enumerate(specs)]).collect()
    got = (r.withColumn("h", pe.pe_hash_udf(["section", "imports", "exports", "richheader"])(
        F.struct(*[raw[b].alias(b) for b in ["section", "imports", "exports", "richheader"]]))).select("h").collect())
    for row, g in zip(jvm, got):
        parts = []
        for i, (b, (kind, _, n, signed)) in enumerate(specs):
            toks = row[f"t{i}"]
            lst = [(p["k"], float(p["v"] or 0.0)) for p in toks] if kind == "pairs" else [(t, 1.0) for t in toks]
            parts.append(hs.hash_rows([lst], n, signed)[0])
        assert np.allclose(np.concatenate(parts), np.array(g["h"]), atol=1e-4)


def test_full_vector_width(spark, sf_small):
    from sigspark.operators.featurize import vectorize_bytes_and_record
    v = vectorize_bytes_and_record(spark, sf_small).select(F.size("features").alias("n")).distinct().collect()
    assert [r["n"] for r in v] == [pe.VECTOR_DIM] == [2568]


def test_warning_normalize(spark):
    df = spark.createDataFrame([("Corrupt header at 0x10",), ("Section .text SizeOfRawData is larger than file.",),
                                ("nothing known",)], "w string")
    out = [r[0] for r in df.select(normalize_warning(F.col("w"))).collect()]
    assert out == ["Corrupt header...", "...SizeOfRawData is larger than file.", None]


def test_empty_blocks_are_zero(spark, sf_small):
    r = pe_records(spark, sf_small).where("raw.header IS NULL").limit(5)
    v = pe.assemble(r, "raw", ["header", "section", "imports", "exports", "datadirectories", "richheader",
                               "authenticode", "pefilewarnings"])
    for row in v.select("features").collect():
        assert len(row[0]) == 1872 and not any(row[0])
