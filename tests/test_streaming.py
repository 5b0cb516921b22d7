from datetime import datetime

from sigspark.streaming import jobs


def test_stream_reads_file_and_folder_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i else None) for i in range(9)], "doc_id long, source string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))         # a folder of files
    part = next((tmp_path / "folder" / "documents.parquet").glob("part-*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())                  # one file
    (tmp_path / "file" / "documents_b.parquet").write_bytes(part.read_bytes())                # another table
    for kind, want in (("folder", {"a": 4, "b": 4}), ("file", None)):
        stream = jobs.read_stream_table(spark, str(tmp_path / kind), "documents", max_files_per_trigger=1)
        got = {r["label"]: r["n"] for r in jobs.drain(spark, jobs.label_counts(stream, "source"), ["label"]).collect()}
        if want is None:
            want = {r["source"]: r["count"] for r in spark.read.parquet(str(part)).where("source is not null").groupBy("source").count().collect()}
        assert got == want


def test_stream_without_files_is_empty(spark, tmp_path):
    spark.createDataFrame([(1, datetime(2024, 1, 1), "x")], "event_id long, ts timestamp, event_type string") \
        .limit(0).write.parquet(str(tmp_path / "events.parquet"))
    stream = jobs.read_stream_table(spark, str(tmp_path), "events")
    assert jobs.drain(spark, jobs.week_counts(stream), ["week_start", "event_type"]).collect() == []
