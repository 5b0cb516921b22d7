"""A document of no characters divides by its length; it is a row like any other."""
import math
import string

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sigspark.sources import pe_standin as ps

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(0, "Hello world. international", "en", "web", 26), (1, "", "en", "web", 0), (2, "", "fr", "web", 0), (3, "ab.", "en", "web", 0), (4, None, "en", "web", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def test_ratio(spark):
    df = spark.createDataFrame([(1, 4), (0, 0), (3, 0), (-3, 0), (None, 0), (3, None)], "x long, n long")
    got = [r[0] for r in df.select(ps.ratio(F.col("x"), F.col("n"))).collect()]
    assert got[0] == 0.25 and math.isnan(got[1]) and got[2:] == [math.inf, -math.inf, None, None]


def test_section_stats_as_the_oracle(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet') WHERE text IS NOT NULL")
    want = sorted(con.execute(entry.oracle_sql()["ft_section_stats"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["ft_section_stats"](spark, folder).where("doc_id <> 4").collect())
    assert repr(got) == repr(want) and [r[0] for r in got] == [0, 1, 3] and "nan" in repr(got)


@pytest.mark.parametrize("name, dim", [("ft_warning_normalize", None), ("ft_section_hash", 224), ("ft_imports_vec", 1282), ("ft_block_subset", 116), ("ft_vector_assemble", 2568)])
def test_every_document_has_a_row(spark, folder, name, dim):
    rows = {r["doc_id"]: r for r in entry.queries()[name](spark, folder).collect()}
    assert set(rows) == {0, 1, 2, 3, 4}
    assert dim is None or {r["dim"] for r in rows.values()} == {dim}


def test_every_letter_has_its_words(spark):
    text = " ".join(f"{c}zz {c}aa {c}{c}{c}" for c in reversed(string.ascii_lowercase))
    r = ps.with_parts(spark.createDataFrame([(1, text, "en", "s", len(text))], SCHEMA)).select(ps.raw_struct()["imports"].alias("i")).first()["i"]
    assert r == {f"{c.upper()}.DLL" if c < "m" else f"{c}.dll": [f"{c}zz", f"{c}aa", c * 3] for c in string.ascii_lowercase}
