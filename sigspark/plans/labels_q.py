"""Registered label / coverage / join / set / split queries.

Stand-in: ``documents`` (left-joined to ``labels``) as samples; family =
source plus a size class (with two sources relabelled to ignored tags),
train = lang in (en, es), test = the rest; binary label = labels.toxic.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import joins as jn
from ..operators import labels as lb
from ..operators import splits as sp
from ..sources import jsonl as sj
from ..sources.standins import landed_lines, raw_record_lines, record_sql, register_tables
from ..sources.tables import table

FAMILY_SQL = """
SELECT d.doc_id, {sha} AS sha256, d.lang, d.source, d.text,
  CASE WHEN d.lang IN ('en', 'es') THEN 'train' ELSE 'test' END AS split,
  CASE WHEN d.source = 'src7' THEN 'win32' WHEN d.source = 'src8' THEN ''
       ELSE concat(d.source, '/', CASE WHEN d.n_chars < 1000 THEN 's' WHEN d.n_chars < 5000 THEN 'm' ELSE 'l' END) END AS family,
  l.toxic AS y_bin
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def fam_sql(engine: str) -> str:
    return FAMILY_SQL.replace("{sha}", "sha2(d.text, 256)" if engine == "spark" else "sha256(d.text)")


def fam(spark: SparkSession, sf: str) -> DataFrame:
    register_tables(spark, sf)
    return spark.sql(fam_sql("spark"))


def _tt(spark, sf):
    f = fam(spark, sf)
    return f.where("split = 'train'"), f.where("split = 'test'")


# ---- Spark queries --------------------------------------------------------------------------

def q_agg_label_counts(spark, sf):
    tr, _ = _tt(spark, sf)
    return lb.label_counts(tr, "family")


def q_agg_label_map(spark, sf):
    tr, _ = _tt(spark, sf)
    return lb.build_label_map(tr, "family", class_min=10)


def q_win_dense_label_id(spark, sf):
    return lb.build_label_map(table(spark, sf, "documents"), "source", class_min=1)


def q_prj_encode_label(spark, sf):
    f = fam(spark, sf)
    m = lb.build_label_map(f.where("split = 'train'"), "family", 10)
    return lb.encode_single_label(f, "family", m).select("doc_id", "y")


def q_join_label_map(spark, sf):
    d = table(spark, sf, "documents")
    m = lb.build_label_map(d.where("lang = 'en'"), "source", 30)
    return jn.lookup_id(d, "source", m, out="y").select("doc_id", "y")


def _words(df):
    return df.withColumn("words", F.split(F.lower("text"), "[^a-z]+"))


def q_prj_multihot(spark, sf):
    f = _words(fam(spark, sf))
    m = lb.build_label_map(f.where("split = 'train'"), "words", class_min=200)
    mh = lb.multihot(f.select("doc_id", "words"), "doc_id", "words", m)
    # every cell of the arrays is read, by generated code: a lambda a cell was most of the time. The first cell of a row
    # stays whatever it holds, so that each row does; rows are told apart by a number, as ids may repeat
    rows = mh.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("y_multi").alias("k"), "y_multi")
    cells = rows.select("doc_id", "row", "k", F.posexplode_outer("y_multi").alias("at", "x"))
    kept = cells.where(F.col("x").isNull() | (F.col("x") != 0) | (F.col("at") == 0))
    sums = kept.groupBy("row", "doc_id", "k").agg(
        F.count_if(F.col("x") != 0).cast("int").alias("n_hot"),
        F.coalesce(F.sum(F.col("x").cast("bigint") * F.col("at")), F.lit(0).cast("bigint")).alias("checksum"))
    return sums.select("doc_id", "n_hot", "checksum", "k")


def q_flt_ignore_tags(spark, sf):
    return lb.filter_ignored(fam(spark, sf), "family").groupBy("split").agg(F.count("*").alias("n"))


def q_flt_file_type_group(spark, sf):
    lines = raw_record_lines(spark, sf).withColumn("fn", sj.parse_filename(F.col("file_name")))
    pe = sj.file_type_group("PE")
    return (lines.where(F.col("fn.file_type_from_name").isin(pe))
            .groupBy(F.col("fn.file_type_from_name").alias("file_type")).agg(F.count("*").alias("n_lines")))


def q_join_inverse_map(spark, sf):
    cust = table(spark, sf, "customer")
    m = (table(spark, sf, "nation").where("n_regionkey <> 0")
         .select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")))
    a = jn.lookup_name(cust.select("c_custkey", "c_nationkey"), "c_nationkey", m, out="name_cascade")
    return jn.lookup_name(a, "c_nationkey", m, out="name_scan", fallback_prefix="class_")


def _encoded(spark, sf):
    f = fam(spark, sf)
    m = lb.build_label_map(f.where("split = 'train'"), "family", 10)
    return lb.encode_single_label(f, "family", m, out="y_fam")


def q_join_align_splits(spark, sf):
    e = _encoded(spark, sf)
    lab = table(spark, sf, "labels")
    binary = lab.select("doc_id", F.col("toxic").alias("y_bin"))
    family = e.join(lab.select("doc_id"), "doc_id", "left_semi").select("doc_id", "y_fam")
    return jn.align_by_key(binary, family, key="doc_id")


def q_join_semi_overlap(spark, sf):
    return cov.semi_overlap(*_tt(spark, sf))


def q_join_anti_only(spark, sf):
    return cov.anti_only(*_tt(spark, sf))


def q_join_full_counts(spark, sf):
    return cov.family_counts(*_tt(spark, sf))


def q_join_class_weight(spark, sf):
    e = _encoded(spark, sf)
    w = sp.class_weights(e.where("split = 'train' AND y_fam <> -1"), "y_fam", "balanced", 20.0)
    return jn.attach_weight(e, "y_fam", w.withColumnRenamed("y_fam", "y")).select("doc_id", "y_fam", "weight")


def q_agg_family_coverage(spark, sf):
    return cov.coverage_report(*_tt(spark, sf), class_min=10)


def q_agg_family_coverage_vec(spark, sf):
    e = _encoded(spark, sf).where("split = 'test'")
    return cov.coverage_from_encoded(e, "y_bin", "y_fam")


def q_srt_topn_unseen(spark, sf):
    return cov.top_unseen(*_tt(spark, sf), class_min=10, top_n=5)


def q_set_intersect_families(spark, sf):
    return cov.overlap_families(*_tt(spark, sf))


def q_set_except_families(spark, sf):
    return cov.except_families(*_tt(spark, sf), class_min=10)


def q_set_union_splits(spark, sf):
    lines = raw_record_lines(spark, sf).where(F.trim("value") != "")
    md = sj.metadata(lines)
    a = md.where("subset = 'train'").select("sha256", "label", "family", "subset")
    b = md.where("subset = 'test'").select("sha256", "label", "file_type", "subset")
    c = md.where("subset = 'challenge'").select("sha256", "detection_ratio", "subset")
    return sj.union_splits([a, b, c])


def q_set_distinct_libs(spark, sf):
    d = table(spark, sf, "documents")
    keys = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0))
    imports = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array(F.lower(k))))
    from ..functions.pe import distinct_libraries
    return d.select("doc_id", F.size(distinct_libraries(imports)).alias("n_libs"))


def q_src_select_files(spark, sf):
    files = sj.list_files(spark, landed_lines(spark, sf), "*", recursive=True).select("file_name").distinct()
    return sj.select_files(files, "train", "Win32").union(sj.select_files(files, "test", None, "2024-01-15"))


def q_src_capped_scan(spark, sf):
    lines = raw_record_lines(spark, sf).where(F.trim("value") != "").withColumnRenamed("doc_id", "line_id")
    return sj.capped_scan(lines, 2, 20).select("split", "file_name", "line_id")


def q_src_file_index(spark, sf):
    listed = sj.list_files(spark, landed_lines(spark, sf), "*", recursive=True)
    files = (listed.groupBy(sj.split_from_path(F.col("path")).alias("split"), "file_name").agg(F.sum("length").alias("length"))
             .select(F.concat(F.lit("/data/"), F.col("split"), F.lit("/"), F.col("file_name")).alias("path"),
                     "file_name", "length"))
    return sj.file_index(files)


def q_src_metadata(spark, sf):
    lines = sj.read_lines(spark, landed_lines(spark, sf))
    return sj.metadata(lines).select("sha256", "label", "file_type", "family", "detection_ratio", "behavior",
                                     "family_confidence", "subset")


def q_win_stratified_split(spark, sf):
    f = fam(spark, sf)
    return sp.stratified_split(f, "source", "doc_id", 0.2, seed=42).select("doc_id", "source", F.col("is_val").cast("int").alias("is_val"))


def q_win_train_val_split(spark, sf):
    f = fam(spark, sf)
    return sp.train_val_split(f, "lang", "doc_id", 0.1, seed=7).select("doc_id", "lang", F.col("is_val").cast("int").alias("is_val"))


def q_win_stratified_sample(spark, sf):
    f = fam(spark, sf)
    return sp.stratified_sample(f, "lang", "doc_id", 300, seed=3).select("doc_id", "lang")


def q_win_class_weights(spark, sf):
    d = table(spark, sf, "documents")
    a = sp.class_weights(d, "lang", "balanced", 20.0).withColumn("mode", F.lit("balanced"))
    b = sp.class_weights(d, "lang", "balanced_sqrt", 2.0).withColumn("mode", F.lit("balanced_sqrt"))
    c = sp.class_weights(d, "lang", "Balanced", None).withColumn("mode", F.lit("Balanced"))
    return a.unionByName(b).unionByName(c)


def q_win_time_series_split(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return sp.time_series_folds(ev, ["ts", "event_id"], 3).select("event_id", "fold", "role")


def q_win_batch_assign(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return sp.batch_assign(ev, "event_id", 512, seed=42, epoch=1).select("event_id", "batch")


QUERIES = {
    "agg_label_counts": q_agg_label_counts,
    "agg_label_map": q_agg_label_map,
    "win_dense_label_id": q_win_dense_label_id,
    "prj_encode_label": q_prj_encode_label,
    "join_label_map": q_join_label_map,
    "prj_multihot": q_prj_multihot,
    "flt_ignore_tags": q_flt_ignore_tags,
    "flt_file_type_group": q_flt_file_type_group,
    "join_inverse_map": q_join_inverse_map,
    "join_align_splits": q_join_align_splits,
    "join_semi_overlap": q_join_semi_overlap,
    "join_anti_only": q_join_anti_only,
    "join_full_counts": q_join_full_counts,
    "join_class_weight": q_join_class_weight,
    "agg_family_coverage": q_agg_family_coverage,
    "agg_family_coverage_vec": q_agg_family_coverage_vec,
    "srt_topn_unseen": q_srt_topn_unseen,
    "set_intersect_families": q_set_intersect_families,
    "set_except_families": q_set_except_families,
    "set_union_splits": q_set_union_splits,
    "set_distinct_libs": q_set_distinct_libs,
    "src_select_files": q_src_select_files,
    "src_capped_scan": q_src_capped_scan,
    "src_file_index": q_src_file_index,
    "src_metadata": q_src_metadata,
    "win_stratified_split": q_win_stratified_split,
    "win_train_val_split": q_win_train_val_split,
    "win_stratified_sample": q_win_stratified_sample,
    "win_class_weights": q_win_class_weights,
    "win_time_series_split": q_win_time_series_split,
    "win_batch_assign": q_win_batch_assign,
}

# ---- DuckDB oracles ---------------------------------------------------------------------------

IGN = "('', 'win32', 'win64', 'elf', 'linux', 'pdf', 'apk', 'android')"
FAM = f"WITH fam AS ({fam_sql('duckdb')})"
MAP = """, tc AS (SELECT family AS label, count(*) AS n FROM fam WHERE split = 'train' AND family IS NOT NULL GROUP BY 1),
lmap AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label ASC) - 1 AS INTEGER) AS id, n
         FROM tc WHERE label NOT IN """ + IGN + """ AND n >= 10)"""
COUNTS = f"""
, trc AS (SELECT family, count(*) AS n FROM fam WHERE split = 'train' AND family IS NOT NULL GROUP BY 1),
tec AS (SELECT family, count(*) AS n FROM fam WHERE split = 'test' AND family IS NOT NULL GROUP BY 1),
fc AS (SELECT coalesce(a.family, b.family) AS family, coalesce(a.n, 0) AS train_count, coalesce(b.n, 0) AS test_count
       FROM trc a FULL OUTER JOIN tec b ON a.family = b.family),
cls AS (SELECT *, train_count > 0 AND family NOT IN {IGN} AS in_train, test_count > 0 AND family NOT IN {IGN} AS in_test,
               train_count >= 10 AND train_count > 0 AND family NOT IN {IGN} AS trained FROM fc),
cls2 AS (SELECT *, in_train AND in_test AS overlap, in_train AND NOT in_test AS only_train,
                in_test AND NOT in_train AS only_test, in_train AND in_test AND NOT trained AS below_min FROM cls)
"""


def _key(seed_expr: str, col: str) -> str:
    return f"('0x' || substr(md5({seed_expr} || '|' || CAST({col} AS VARCHAR)), 1, 15))::BIGINT"


ORACLE = {
    "agg_label_counts": FAM + " SELECT family AS label, count(*) AS n FROM fam WHERE split = 'train' AND family IS NOT NULL GROUP BY 1",
    "agg_label_map": FAM + MAP + " SELECT * FROM lmap",
    "win_dense_label_id": """
WITH c AS (SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS id, n FROM c
WHERE label NOT IN """ + IGN + " AND n >= 1",
    "prj_encode_label": FAM + MAP + """
SELECT f.doc_id, CAST(coalesce(m.id, -1) AS INTEGER) AS y FROM fam f LEFT JOIN lmap m ON f.family = m.label""",
    "join_label_map": """
WITH c AS (SELECT source AS label, count(*) AS n FROM documents WHERE lang = 'en' AND source IS NOT NULL GROUP BY 1),
m AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS id FROM c
      WHERE label NOT IN """ + IGN + """ AND n >= 30)
SELECT d.doc_id, CAST(coalesce(m.id, -1) AS INTEGER) AS y FROM documents d LEFT JOIN m ON d.source = m.label""",
    "prj_multihot": FAM + """
, w AS (SELECT doc_id, split, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM fam),
tc AS (SELECT word AS label, count(*) AS n FROM w WHERE split = 'train' GROUP BY 1),
m AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS id FROM tc WHERE label NOT IN """ + IGN + """ AND n >= 200),
hits AS (SELECT DISTINCT w.doc_id, m.id FROM w JOIN m ON w.word = m.label),
agg AS (SELECT doc_id, count(*) AS n_hot, sum(id) AS checksum FROM hits GROUP BY 1)
SELECT f.doc_id, CAST(coalesce(n_hot, 0) AS INTEGER) AS n_hot, coalesce(checksum, 0) AS checksum,
       CAST((SELECT count(*) FROM m) AS INTEGER) AS k
FROM fam f LEFT JOIN agg USING (doc_id)""",
    "flt_ignore_tags": FAM + " SELECT split, count(*) AS n FROM fam WHERE family NOT IN " + IGN + " OR family IS NULL GROUP BY split",
    "join_inverse_map": """
WITH m AS (SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_regionkey <> 0)
SELECT c.c_custkey, c.c_nationkey, m.label AS name_cascade,
       CASE WHEN c.c_nationkey IS NULL THEN NULL ELSE coalesce(m.label, 'class_' || CAST(c.c_nationkey AS VARCHAR)) END AS name_scan
FROM customer c LEFT JOIN m ON c.c_nationkey = m.id""",
    "join_align_splits": FAM + MAP + """
SELECT l.doc_id, l.toxic AS y_bin, CAST(coalesce(m.id, -1) AS INTEGER) AS y_fam
FROM labels l JOIN fam f ON l.doc_id = f.doc_id LEFT JOIN lmap m ON f.family = m.label""",
    "join_semi_overlap": FAM + COUNTS + " SELECT family, train_count AS n FROM cls2 WHERE overlap",
    "join_anti_only": FAM + COUNTS + """ SELECT family, train_count AS n, 'train' AS side FROM cls2 WHERE only_train
UNION ALL SELECT family, test_count, 'test' FROM cls2 WHERE only_test""",
    "join_full_counts": FAM + COUNTS + " SELECT family, train_count, test_count FROM fc",
    "join_class_weight": FAM + MAP + """
, e AS (SELECT f.doc_id, f.split, CAST(coalesce(m.id, -1) AS INTEGER) AS y_fam FROM fam f LEFT JOIN lmap m ON f.family = m.label),
c AS (SELECT y_fam, count(*) AS n FROM e WHERE split = 'train' AND y_fam <> -1 GROUP BY 1),
w AS (SELECT y_fam, least(greatest(sum(n) OVER () / (count(*) OVER () * n), 1.0 / 20), 20.0) AS weight FROM c)
SELECT e.doc_id, e.y_fam, coalesce(w.weight, 1.0) AS weight FROM e LEFT JOIN w USING (y_fam)""",
    "agg_family_coverage": FAM + COUNTS + """
SELECT count_if(in_train) AS n_families_train_raw, count_if(trained) AS n_families_train_used_as_class,
  count_if(in_test) AS n_families_test_raw, count_if(overlap) AS n_families_overlap,
  count_if(only_train) AS n_families_only_train, count_if(only_test) AS n_families_only_test_never_seen,
  count_if(below_min) AS n_families_below_class_min, coalesce(sum(test_count), 0) AS total_test_malware_samples,
  coalesce(sum(CASE WHEN only_test OR below_min THEN test_count ELSE 0 END), 0) AS test_samples_invisible_to_model,
  coalesce(sum(CASE WHEN only_test OR below_min THEN test_count ELSE 0 END) / nullif(sum(test_count), 0), 0.0) AS test_samples_invisible_rate
FROM cls2""",
    "agg_family_coverage_vec": FAM + MAP + """
, e AS (SELECT f.y_bin, CAST(coalesce(m.id, -1) AS INTEGER) AS y_fam FROM fam f LEFT JOIN lmap m ON f.family = m.label WHERE f.split = 'test')
SELECT count_if(y_bin = 1) AS true_malware_samples_in_test, count_if(y_bin = 1 AND y_fam <> -1) AS known_family_samples_in_test,
  count_if(y_bin = 1 AND y_fam = -1) AS unseen_family_samples_in_test,
  coalesce(count_if(y_bin = 1 AND y_fam = -1) / nullif(count_if(y_bin = 1), 0), 0.0) AS unseen_family_rate,
  count(DISTINCT CASE WHEN y_bin = 1 AND y_fam <> -1 THEN y_fam END) AS n_family_classes_seen_in_test
FROM e""",
    "srt_topn_unseen": FAM + COUNTS + """
SELECT * FROM (SELECT 'never_seen_in_train' AS list, family, test_count, CAST(NULL AS BIGINT) AS train_count FROM cls2
               WHERE only_test ORDER BY test_count DESC, family LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'below_class_min', family, test_count, train_count FROM cls2
               WHERE below_min ORDER BY test_count DESC, family LIMIT 5)""",
    "set_intersect_families": FAM + COUNTS + " SELECT family FROM cls2 WHERE overlap",
    "set_except_families": FAM + COUNTS + """ SELECT family, 'only_train' AS set FROM cls2 WHERE only_train
UNION ALL SELECT family, 'only_test' FROM cls2 WHERE only_test
UNION ALL SELECT family, 'below_class_min' FROM cls2 WHERE below_min""",
    "set_distinct_libs": """
SELECT doc_id, CAST(len(list_distinct(list_transform(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')), lambda k: lower(k)))) AS INTEGER) AS n_libs
FROM documents""",
    "win_stratified_split": FAM + """
, c AS (SELECT source, count(*) AS n FROM fam GROUP BY 1),
q AS (SELECT source, least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), n - 1) AS q FROM c),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY """ + _key("'42'", "doc_id") + """) AS rn FROM fam)
SELECT r.doc_id, r.source, CAST(r.rn <= q.q AS INTEGER) AS is_val FROM r JOIN q USING (source)""",
    "win_train_val_split": FAM + """
, c AS (SELECT lang, count(*) AS n FROM fam GROUP BY 1),
tot AS (SELECT sum(n) AS n FROM c),
nv AS (SELECT least(greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)), n - 1) AS nv FROM tot),
i AS (SELECT c.lang, c.n, nv.nv * c.n / tot.n AS ideal, floor(nv.nv * c.n / tot.n) AS fl, nv.nv AS nv FROM c, tot, nv),
q0 AS (SELECT *, nv - sum(fl) OVER () AS left_, row_number() OVER (ORDER BY ideal - fl DESC, lang ASC) AS rk FROM i),
q AS (SELECT lang, fl + CASE WHEN rk <= left_ THEN 1 ELSE 0 END AS q FROM q0),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY """ + _key("'7'", "doc_id") + """) AS rn FROM fam)
SELECT r.doc_id, r.lang, CAST(r.rn <= q.q AS INTEGER) AS is_val FROM r JOIN q USING (lang)""",
    "win_stratified_sample": FAM + """
, c AS (SELECT lang, count(*) AS n FROM fam GROUP BY 1),
tot AS (SELECT sum(n) AS n FROM c),
i AS (SELECT c.lang, 300 * c.n / tot.n AS ideal, floor(300 * c.n / tot.n) AS fl FROM c, tot),
q0 AS (SELECT *, 300 - sum(fl) OVER () AS left_, row_number() OVER (ORDER BY ideal - fl DESC, lang ASC) AS rk FROM i),
q AS (SELECT lang, fl + CASE WHEN rk <= left_ THEN 1 ELSE 0 END AS q FROM q0),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY """ + _key("'3'", "doc_id") + """) AS rn FROM fam)
SELECT r.doc_id, r.lang FROM r JOIN q USING (lang) WHERE r.rn <= q.q""",
    "win_class_weights": """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, n, least(greatest(sum(n) OVER () / (count(*) OVER () * n), 1.0 / 20), 20.0) AS weight, 'balanced' AS mode FROM c
UNION ALL SELECT lang, n, least(greatest(sqrt(sum(n) OVER () / (count(*) OVER () * n)), 0.5), 2.0), 'balanced_sqrt' FROM c
UNION ALL SELECT lang, n, max(n) OVER () / n, 'Balanced' FROM c""",
    "win_time_series_split": """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
t AS (SELECT *, n // 4 AS t FROM r),
f AS (SELECT event_id, pos, n, t, unnest([0, 1, 2]) AS fold FROM t),
g AS (SELECT *, n - (3 - fold) * t AS start FROM f)
SELECT event_id, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role
FROM g WHERE pos < start + t""",
    "win_batch_assign": """
SELECT event_id, (row_number() OVER (ORDER BY """ + _key("'42|1'", "event_id") + """, event_id) - 1) // 512 AS batch FROM events""",
}

FNP = r"^(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_(.+)_(train|test|challenge)\.jsonl$"
LINES = f"WITH lines AS ({record_sql('duckdb')})"
MD = LINES + """
, md AS (SELECT
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.sha256') END AS sha256,
    CASE WHEN json_valid(value) THEN TRY_CAST(json_extract_string(value, '$.label') AS INTEGER) END AS label,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.file_type') END AS file_type,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.family') END AS family,
    CASE WHEN json_valid(value) THEN CASE WHEN json_type(value, '$.detection_ratio') = 'NULL' THEN NULL WHEN json_type(value, '$.detection_ratio') = 'VARCHAR'
         THEN json_extract_string(value, '$.detection_ratio') ELSE json_extract(value, '$.detection_ratio')::VARCHAR END END AS detection_ratio,
    CASE WHEN json_valid(value) THEN CASE WHEN json_type(value, '$.behavior') = 'NULL' THEN NULL WHEN json_type(value, '$.behavior') = 'VARCHAR'
         THEN json_extract_string(value, '$.behavior') ELSE json_extract(value, '$.behavior')::VARCHAR END END AS behavior,
    CASE WHEN json_valid(value) THEN CASE WHEN json_type(value, '$.family_confidence') = 'NULL' THEN NULL WHEN json_type(value, '$.family_confidence') = 'VARCHAR'
         THEN json_extract_string(value, '$.family_confidence') ELSE json_extract(value, '$.family_confidence')::VARCHAR END END AS family_confidence,
    split AS subset
  FROM lines WHERE trim(value) <> '' AND json_valid(value))
"""
ORACLE.update({
    "flt_file_type_group": LINES + f"""
SELECT regexp_extract(file_name, '{FNP}', 3) AS file_type, count(*) AS n_lines FROM lines
WHERE regexp_extract(file_name, '{FNP}', 3) IN ('Win32', 'Win64', 'Dot_Net') GROUP BY 1""",
    "set_union_splits": MD + """
SELECT sha256, label, family, subset FROM md WHERE subset = 'train'
UNION ALL BY NAME SELECT sha256, label, file_type, subset FROM md WHERE subset = 'test'
UNION ALL BY NAME SELECT sha256, detection_ratio, subset FROM md WHERE subset = 'challenge'""",
    "src_metadata": MD + "SELECT sha256, label, file_type, family, detection_ratio, behavior, family_confidence, subset FROM md",
    "src_select_files": LINES + """
, f AS (SELECT DISTINCT file_name FROM lines)
SELECT file_name FROM f WHERE contains(file_name, 'train') AND contains(file_name, 'Win32')
UNION ALL SELECT file_name FROM f WHERE contains(file_name, 'test') AND contains(file_name, '2024-01-15')""",
    "src_capped_scan": LINES + """
, nb AS (SELECT * FROM lines WHERE trim(value) <> ''),
f AS (SELECT split, file_name, row_number() OVER (PARTITION BY split ORDER BY file_name) AS r FROM (SELECT DISTINCT split, file_name FROM nb)),
k AS (SELECT nb.* FROM nb JOIN f USING (split, file_name) WHERE f.r <= 2)
SELECT split, file_name, doc_id AS line_id FROM
  (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY doc_id) AS l FROM k) WHERE l <= 20""",
    "src_file_index": LINES + f"""
, files AS (SELECT split, file_name, sum(octet_length(encode(value)) + 1) AS length FROM lines GROUP BY ALL)
SELECT '/data/' || split || '/' || file_name AS path, file_name, split, length AS size_bytes,
  CASE WHEN regexp_matches(file_name, '{FNP}') THEN regexp_extract(file_name, '{FNP}', 1) END AS week_start,
  CASE WHEN regexp_matches(file_name, '{FNP}') THEN regexp_extract(file_name, '{FNP}', 2) END AS week_end,
  CASE WHEN regexp_matches(file_name, '{FNP}') THEN regexp_extract(file_name, '{FNP}', 3) END AS file_type_from_name,
  regexp_matches(file_name, '{FNP}') AS valid_name_pattern
FROM files""",
})
