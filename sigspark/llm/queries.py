"""Registered queries of the operators: thin callers over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe, fingerprints, hard_negatives, langid, licenses, near_dedup, ngram_lm, packing, quality, ranked_search, suffix_dedup, token_files, topk
from sigspark.llm.frames import crc_mod, documents
from sigspark.llm.tokenization import tokenizer_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.filter(crc_mod("doc_id", 3) != 1))
    return langid.predict(docs, model, carry={
        "doc_id": F.col("doc_id"), "held_out": F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))})


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(documents(spark, sf_dir))).withColumnRenamed("doc", "doc_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("doc", "doc_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(documents(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "class_size", "class_key")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def op6_topk_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(rows, F.col("vec_id") % 100 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("doc", "doc_id")


def op9_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = crc_mod("doc_id", 5)
    return ngram_lm.score(documents(spark, sf_dir).select("doc_id", "text"), rest != 1, carry={
        "doc_id": F.col("doc_id"), "held_out": F.coalesce(rest == 1, F.lit(False))})


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)
    rows = token_files.read_token_files(spark, path)
    return rows.select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_topk_voronoi": op6_topk_voronoi,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe_tree": op8_bpe_tree,
    "op9_ngram_scores": op9_ngram_scores,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fingerprints": op12_fingerprints,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op6_topk_voronoi": """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.vec, d.vec)]) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id
    WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10""",
    "op11_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, d.vec_id AS vec_id, a.label = d.label AS same,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.vec, d.vec)]) AS BIGINT) AS score
    FROM v a JOIN v d ON a.vec_id <> d.vec_id
    WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5""",
    "op13_ranked_search": r"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (
    SELECT DISTINCT b, item_id, term
    FROM (SELECT row_number() OVER () AS b, item_id,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark)),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(g.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
i AS (
    SELECT p.r, p.doc_id, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * n.n * g.docs) // g.total))) AS impact
    FROM p JOIN w USING (term) JOIN n USING (r), g),
s AS (SELECT q.b, q.item_id, i.r, i.doc_id, CAST(sum(i.impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
