"""The pipeline's stages: schemas, decisions, and a brute-force check of what each keeps."""
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sigspark.llm.frames import written

from test_joins import brute_classes, brute_repeats


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    english = ["the", "of", "and", "house", "water", "morning", "people", "through", "where", "night", "garden", "bread"]
    german = ["der", "und", "nicht", "haus", "wasser", "morgen", "leute", "durch", "garten", "brot", "schön", "über"]
    prose = lambda words, n: " ".join(rnd.choice(words) + str(rnd.choice(["", "", "s", "en"])) for _ in range(n))
    shared = prose(english, 70)
    rows = []
    for i in range(60):
        text = prose(english if i % 2 else german, rnd.randint(60, 150))
        rows.append((i, text + (" " + shared if i % 10 == 1 else ""), "en" if i % 2 else "de", "s", 1))
    rows += [(100 + i, rows[i][1], rows[i][2], "s", 1) for i in range(5)]                 # exact copies
    rows += [(200, rows[6][1] + " end", "de", "s", 1), (201, None, None, None, None), (None, "12 34", "en", "s", 2),
             (202, "short text", "en", "s", 1), (203, "again and again " * 60, "en", "s", 1)]
    rows += [rows[7]]                                                                      # a repeated row
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("kept", F.lit("extra")).withColumn("score", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "suffix_dedup", "packing"]

    def step(name, frame):
        out = written(stages[name](spark, frame, corpus), name)
        assert out.columns == frame.columns
        return out, out.collect()

    one, rows = step("language_id", docs)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows} == {201, None}
    two, rows = step("quality_rules", one)
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in rows} == {202, 203}
    before = rows
    three, rows = step("near_dedup", two)
    before = sorted(before, key=lambda r: r.doc_id)
    expected = brute_classes([r.text for r in before])
    assert sorted(r.doc_id for r in rows) == sorted(before[c].doc_id for c in set(expected))
    before = rows
    four, rows = step("suffix_dedup", three)
    want = {r.doc_id: kept.decode() for r, (_, _, kept) in zip(before, brute_repeats([r.text.encode() for r in before], 200))}
    assert {r.doc_id: r.text for r in rows} == want
    assert any(len(want[r.doc_id]) < len(r.text) for r in before)
    assert all(r.n_chars in (1, len(r.text)) for r in rows)
    packed = stages["packing"](spark, four, corpus).collect()
    assert {r.doc_id for r in packed} == set(want)
    per = {}
    for r in packed:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
    assert max(per.values()) <= 2048


def test_run_and_empty_table(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
