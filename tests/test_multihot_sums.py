"""prj_multihot's sums over the wide arrays: no lambda for each cell, and a row for each document, whatever its id."""
import __spark_entry__ as entry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows(spark, d, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = entry.queries()["prj_multihot"](spark, d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "transform(" not in plan and "aggregate(" not in plan
    return sorted(map(repr, map(tuple, out.collect())))


def test_every_document_has_its_sums(spark, tmp_path):
    much = "alpha " * 300 + "beta " * 250 + "gamma " * 200
    docs = [(1, much, "en", "a", 9), (2, "beta gamma delta", "fr", "a", 9), (2, "alpha", "fr", "a", 9), (2, "alpha", "fr", "a", 9),
            (None, "gamma", "fr", "a", 9), (3, None, "fr", "a", 9), (4, "delta", "fr", "a", 9)]
    assert _rows(spark, str(tmp_path), docs) == sorted(map(repr, [
        (1, 3, 3, 3), (2, 2, 3, 3), (2, 1, 0, 3), (2, 1, 0, 3), (None, 1, 2, 3), (3, 0, 0, 3), (4, 0, 0, 3)]))


def test_without_any_label(spark, tmp_path):
    assert _rows(spark, str(tmp_path), [(1, "alpha", "en", "a", 5), (2, None, "fr", "a", 0)]) == ["(1, 0, 0, 0)", "(2, 0, 0, 0)"]
