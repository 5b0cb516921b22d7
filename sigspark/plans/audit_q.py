"""Registered audit / source / JSON-helper queries over the raw-record stand-in lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonval as jv
from ..operators import audit as au
from ..sources import jsonl as sj
from ..sources.standins import landed_lines, raw_record_lines, record_sql

# ---------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------


def _parsed(spark, sf):
    return au.parse_records(raw_record_lines(spark, sf))


def _recs(spark, sf):
    return au.records(_parsed(spark, sf))


def q_src_jsonl(spark, sf):
    p = au.parse_records(sj.read_lines(spark, landed_lines(spark, sf)))
    return p.groupBy("split").agg(F.count("*").alias("n_lines"), F.count_if(F.col("rec").isNotNull()).alias("n_records"))


def q_src_rowcount(spark, sf):
    return sj.row_counts(sj.read_lines(spark, landed_lines(spark, sf)))


def q_src_parse_filename(spark, sf):
    lines = raw_record_lines(spark, sf)
    names = lines.select(F.col("file_name").alias("name")).union(
        lines.select(F.concat(F.lit("x_"), F.col("file_name")).alias("name"))).distinct()
    p = au.parse_filename(F.col("name"))
    return names.select("name", p["week_start"].alias("week_start"), p["week_end"].alias("week_end"),
                        p["file_type_from_name"].alias("file_type_from_name"),
                        p["subset_from_name"].alias("subset_from_name"),
                        p["valid_name_pattern"].cast("int").alias("valid_name_pattern"))


def q_src_split_from_path(spark, sf):
    lines = raw_record_lines(spark, sf)
    paths = lines.select(F.concat(F.lit("/Data/"), F.upper(F.col("split")), F.lit("/"), F.col("file_name")).alias("path")).union(
        lines.select(F.concat(F.lit("/data/x"), F.col("split"), F.lit("/"), F.col("file_name")).alias("path"))).distinct()
    return paths.select("path", au.split_from_path(F.col("path")).alias("split"))


def q_agg_bad_rows(spark, sf):
    return au.bad_rows(_parsed(spark, sf))


def q_agg_file_overview(spark, sf):
    return au.file_overview(raw_record_lines(spark, sf))


def q_agg_split_overview(spark, sf):
    return au.split_overview(_recs(spark, sf))


def q_agg_label_dist(spark, sf):
    return au.label_distribution(_recs(spark, sf))


def q_agg_label_pivot(spark, sf):
    return au.label_pivot(_recs(spark, sf), ["-1", "0", "1", "null"])


def q_agg_filetype_dist(spark, sf):
    return au.filetype_distribution(_recs(spark, sf))


def q_agg_week_timeline(spark, sf):
    return au.week_timeline(_recs(spark, sf))


#: File types of the stand-in records (from the records and from file names).
WEEK_TYPES = ["de", "en", "es", "fr", "Dot_Net", "Win32", "Win64"]


def q_agg_week_type_pivot(spark, sf):
    return au.week_type_pivot(_recs(spark, sf), WEEK_TYPES)


def q_agg_field_coverage(spark, sf):
    return au.field_coverage(_recs(spark, sf))


def q_agg_block_coverage(spark, sf):
    return au.block_coverage(_recs(spark, sf))


def q_agg_numeric_summary(spark, sf):
    return au.numeric_summary(_recs(spark, sf))


def q_agg_stage2_summary(spark, sf):
    return au.stage2_summary(_recs(spark, sf))


def q_agg_stage2_topvalues(spark, sf):
    return au.stage2_top_values(_recs(spark, sf))


def q_agg_support_audit(spark, sf):
    return au.support_audit(_recs(spark, sf))


def q_agg_shape_dist(spark, sf):
    return au.shape_distribution(_recs(spark, sf))


def q_agg_examples(spark, sf):
    return au.examples(_recs(spark, sf))


def q_prj_record_view(spark, sf):
    return au.record_view(_recs(spark, sf))


def q_prj_raw_preview(spark, sf):
    return au.raw_preview(_recs(spark, sf))


def q_prj_project_findings(spark, sf):
    return au.project_findings(_recs(spark, sf))


def q_flt_malware_only(spark, sf):
    r = _recs(spark, sf)
    return r.where(F.col("label_num") == 1).groupBy("split").agg(F.count("*").alias("n_malware"))


def q_prj_nested_get(spark, sf):
    r = _recs(spark, sf)
    rec = F.col("rec")
    return r.select("doc_id",
                    jv.as_double(jv.nested_get(rec, "general", "size")).alias("general_size"),
                    jv.as_double(jv.nested_get(rec, "strings", "numstrings")).alias("numstrings"),
                    jv.as_double(jv.nested_get(rec, "header", "coff", "timestamp")).alias("coff_timestamp"),
                    jv.as_double(jv.nested_get(rec, "family", "x")).alias("family_x"))


def q_prd_nonempty(spark, sf):
    r = _recs(spark, sf)
    fields = ["label", "family", "family_confidence", "behavior", "packer", "group", "strings", "histogram",
              "imports", "exports", "header", "file_property"]
    return r.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"),
                                                jv.is_nonempty(jv.nested_get(F.col("rec"), f)).alias("ne"))
                                       for f in fields]))) \
        .groupBy("field").agg(F.count_if("ne").alias("nonempty_count"), F.count("*").alias("n"))


def q_prj_value_shape(spark, sf):
    r = _recs(spark, sf)
    kv = r.select("split", F.explode(jv.as_object(F.col("rec"))).alias("field", "v"))
    return kv.groupBy("split", "field", jv.value_shape(F.col("v")).alias("shape")).agg(F.count("*").alias("count"))


def q_prj_detection_ratio(spark, sf):
    r = _recs(spark, sf)
    d = jv.detection_ratio(jv.nested_get(F.col("rec"), "detection_ratio"))
    return r.select("doc_id", d["hits"].alias("hits"), d["total"].alias("total"))


def q_prj_normalize_labels(spark, sf):
    r = _recs(spark, sf)
    items = F.array(*[F.struct(F.lit(f).alias("field"), jv.nested_get(F.col("rec"), f).alias("v"))
                      for f in ["behavior", "packer", "group", "family_confidence"]])
    t = r.select("doc_id", F.inline(items))
    return t.select("doc_id", "field", F.array_join(F.array_sort(jv.normalize_labels(F.col("v"))), "|").alias("labels"))


def q_prj_read_label(spark, sf):
    from ..operators.labels import read_label
    lines = raw_record_lines(spark, sf).where(F.trim("value") != "")
    return lines.select("doc_id", jv.as_string(read_label(F.col("value"), "label")).alias("label"),
                        jv.as_string(read_label(F.col("value"), "family")).alias("family"))


QUERIES = {
    "src_jsonl": q_src_jsonl,
    "src_rowcount": q_src_rowcount,
    "src_parse_filename": q_src_parse_filename,
    "src_split_from_path": q_src_split_from_path,
    "agg_bad_rows": q_agg_bad_rows,
    "agg_file_overview": q_agg_file_overview,
    "agg_split_overview": q_agg_split_overview,
    "agg_label_dist": q_agg_label_dist,
    "agg_label_pivot": q_agg_label_pivot,
    "agg_filetype_dist": q_agg_filetype_dist,
    "agg_week_timeline": q_agg_week_timeline,
    "agg_week_type_pivot": q_agg_week_type_pivot,
    "agg_field_coverage": q_agg_field_coverage,
    "agg_block_coverage": q_agg_block_coverage,
    "agg_numeric_summary": q_agg_numeric_summary,
    "agg_stage2_summary": q_agg_stage2_summary,
    "agg_stage2_topvalues": q_agg_stage2_topvalues,
    "agg_support_audit": q_agg_support_audit,
    "agg_shape_dist": q_agg_shape_dist,
    "agg_examples": q_agg_examples,
    "prj_record_view": q_prj_record_view,
    "prj_raw_preview": q_prj_raw_preview,
    "prj_project_findings": q_prj_project_findings,
    "flt_malware_only": q_flt_malware_only,
    "prj_nested_get": q_prj_nested_get,
    "prd_nonempty": q_prd_nonempty,
    "prj_value_shape": q_prj_value_shape,
    "prj_detection_ratio": q_prj_detection_ratio,
    "prj_normalize_labels": q_prj_normalize_labels,
    "prj_read_label": q_prj_read_label,
}

# ---------------------------------------------------------------------------------------------
# DuckDB oracles (same lines, parsed with DuckDB's JSON functions)
# ---------------------------------------------------------------------------------------------

FNP = au.FILENAME_PATTERN
NUM = "('BIGINT','UBIGINT','DOUBLE')"
TRIM = r"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


def _ne(v: str, ty: str) -> str:
    return (f"(CASE WHEN {ty} IS NULL OR {ty} = 'NULL' THEN false "
            f"WHEN {ty} = 'VARCHAR' THEN {TRIM.format(s=f'json_extract_string({v}, $$$$)')} <> '' "
            f"WHEN {ty} = 'ARRAY' THEN json_array_length({v}) > 0 "
            f"WHEN {ty} = 'OBJECT' THEN len(json_keys({v})) > 0 ELSE true END)").replace("$$$$", "'$'")


def _shape(ty: str) -> str:
    return (f"(CASE WHEN {ty} IS NULL OR {ty} = 'NULL' THEN 'none' WHEN {ty} = 'VARCHAR' THEN 'string' "
            f"WHEN {ty} = 'BOOLEAN' THEN 'bool' WHEN {ty} IN ('BIGINT','UBIGINT') THEN 'int' "
            f"WHEN {ty} = 'DOUBLE' THEN 'float' WHEN {ty} = 'ARRAY' THEN 'list' WHEN {ty} = 'OBJECT' THEN 'dict' END)")


def _get(path_expr: str) -> str:
    return f"json_extract(rec, {path_expr})"


EACH = "AS {a}(k, v, ty, atom, eid, parent, fullkey, epath)"

BASE = f"""
WITH lines AS ({record_sql('duckdb')}),
parsed AS (SELECT doc_id, split, file_name, value, CASE WHEN json_valid(value) THEN value::JSON END AS rec
           FROM lines WHERE trim(value) <> ''),
recs AS (
  SELECT doc_id, split, file_name, value, rec,
    json_extract_string(rec, '$.label') AS label_s,
    CASE WHEN json_type(rec, '$.label') IN {NUM} THEN CAST(json_extract_string(rec, '$.label') AS DOUBLE) END AS label_num,
    CASE WHEN json_type(rec, '$.file_type') IS NOT NULL THEN json_extract_string(rec, '$.file_type')
         ELSE NULLIF(regexp_extract(file_name, '{FNP}', 3), '') END AS file_type,
    CASE WHEN json_type(rec, '$.week_id') IS NOT NULL THEN json_extract_string(rec, '$.week_id')
         ELSE NULLIF(regexp_extract(file_name, '{FNP}', 1), '') END AS week
  FROM parsed WHERE rec IS NOT NULL)
"""


def _targets_cte(fields: list[str]) -> str:
    vals = ", ".join(f"('{f}')" for f in fields)
    return f""",
tgt AS (
  SELECT r.doc_id, r.split, f.field, json_extract(r.rec, '$."' || f.field || '"') AS v,
         json_type(r.rec, '$."' || f.field || '"') AS ty
  FROM recs r, (VALUES {vals}) f(field) WHERE r.label_num = 1),
el AS (SELECT t.doc_id, t.split, t.field, e.v AS ev, e.ty AS ety FROM tgt t, json_each(t.v) {EACH.format(a='e')} WHERE t.ty = 'ARRAY'),
items AS (
  SELECT doc_id, split, field, v, ty FROM tgt WHERE ty IS NOT NULL AND ty <> 'ARRAY'
  UNION ALL SELECT doc_id, split, field, ev, ety FROM el WHERE ety <> 'ARRAY'
  UNION ALL SELECT el.doc_id, el.split, el.field, e2.v, e2.ty FROM el, json_each(el.ev) {EACH.format(a='e2')} WHERE el.ety = 'ARRAY'),
labs0 AS (
  SELECT doc_id, split, field, {TRIM.format(s="json_extract_string(v, '$')")} AS value FROM items WHERE ty = 'VARCHAR'
  UNION ALL SELECT doc_id, split, field,
    CASE WHEN ty = 'BOOLEAN' THEN CASE WHEN json_extract_string(v, '$') = 'true' THEN 'True' ELSE 'False' END
         ELSE json_extract_string(v, '$') END FROM items WHERE ty IN ('BIGINT','UBIGINT','DOUBLE','BOOLEAN')
  UNION ALL SELECT i.doc_id, i.split, i.field,
    CASE WHEN o.ty = 'BOOLEAN' THEN CASE WHEN o.v::VARCHAR = 'true' THEN o.k END
         WHEN o.ty IN {NUM} THEN CASE WHEN CAST(o.v::VARCHAR AS DOUBLE) <> 0 THEN o.k || '=' || o.v::VARCHAR END
         WHEN {_ne('o.v', 'o.ty')} THEN o.k END
    FROM items i, json_each(i.v) {EACH.format(a='o')} WHERE i.ty = 'OBJECT'),
labs AS (SELECT * FROM labs0 WHERE value IS NOT NULL AND value <> ''),
vc AS (SELECT split, field, value, count(*) AS count FROM labs GROUP BY ALL)
"""


S2 = ["family", "behavior", "file_property", "packer", "exploit", "group"]

STAGE2_SUMMARY_BODY = f"""
, base AS (SELECT split, field, count(*) AS malware_records, count_if({_ne('v', 'ty')}) AS present_count FROM tgt GROUP BY ALL),
shp AS (SELECT split, field, {_shape('ty')} AS shape, count(*) AS n FROM tgt GROUP BY ALL),
shp1 AS (SELECT split, field, shape AS dominant_raw_shape FROM
         (SELECT *, row_number() OVER (PARTITION BY split, field ORDER BY n DESC, shape ASC) AS r FROM shp) WHERE r = 1),
tot AS (SELECT split, field, count(*) AS n_unique_values, sum(count) AS s FROM vc GROUP BY ALL),
top1 AS (SELECT split, field, value AS top1_value, count AS top1_count FROM
         (SELECT *, row_number() OVER (PARTITION BY split, field ORDER BY count DESC, value ASC) AS r FROM vc) WHERE r = 1)
"""

STAGE2_SUMMARY_SQL = BASE + _targets_cte(S2) + STAGE2_SUMMARY_BODY + """
SELECT b.split, b.field, malware_records, present_count, present_count / malware_records AS coverage_in_malware,
       coalesce(n_unique_values, 0) AS n_unique_values, dominant_raw_shape, top1_value,
       coalesce(top1_count, 0) AS top1_count, top1_count / s AS top1_ratio_among_present
FROM base b LEFT JOIN shp1 USING (split, field) LEFT JOIN tot USING (split, field) LEFT JOIN top1 USING (split, field)
"""

SUPPORT_SQL = BASE + _targets_cte(["family_confidence"]) + STAGE2_SUMMARY_BODY + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY split, field ORDER BY count DESC, value ASC) AS rank FROM vc),
prev AS (SELECT split, field, '[' || string_agg(printf('(''%s'', %d)', value, count), ', ' ORDER BY rank) || ']' AS top_values_preview
         FROM ranked WHERE rank <= 10 GROUP BY ALL)
SELECT b.split, b.field, malware_records, present_count, present_count / malware_records AS coverage_in_malware,
       coalesce(n_unique_values, 0) AS n_unique_values, dominant_raw_shape, coalesce(top_values_preview, '[]') AS top_values_preview
FROM base b LEFT JOIN shp1 USING (split, field) LEFT JOIN tot USING (split, field) LEFT JOIN prev USING (split, field)
"""

TOPVALUES_SQL = BASE + _targets_cte(S2) + """
SELECT * FROM (SELECT split, field, value, count,
   row_number() OVER (PARTITION BY split, field ORDER BY count DESC, value ASC) AS rank FROM vc) WHERE rank <= 20
"""

SHAPE_SQL = BASE + _targets_cte(S2) + f"""
SELECT split, field, {_shape('ty')} AS raw_shape, count(*) AS count FROM tgt GROUP BY ALL
"""

EXAMPLES_SQL = BASE + _targets_cte(S2 + ["family_confidence"]) + """
, hasl AS (SELECT DISTINCT doc_id, split, field FROM labs),
ex AS (SELECT t.split, t.field, t.doc_id,
          substr(CASE WHEN t.ty = 'VARCHAR' THEN json_extract_string(t.v, '$') ELSE t.v::VARCHAR END, 1, 300) AS example
       FROM tgt t JOIN hasl h USING (doc_id, split, field))
SELECT split, field, rank, example FROM
  (SELECT *, row_number() OVER (PARTITION BY split, field ORDER BY doc_id) AS rank FROM ex) WHERE rank <= 5
"""

BLOCKS = ["histogram", "byteentropy", "strings", "general", "header", "section", "imports", "exports",
          "datadirectories", "richheader", "authenticode", "pefilewarnings"]


def _block_cov_cte() -> str:
    vals = ", ".join(f"('{b}')" for b in BLOCKS)
    return f""",
btot AS (SELECT split, count(*) AS t FROM recs GROUP BY split),
bv AS (SELECT r.split, b.block, json_extract(r.rec, '$.' || b.block) AS v, json_type(r.rec, '$.' || b.block) AS ty
       FROM recs r, (VALUES {vals}) b(block)),
bc AS (SELECT bv.split, block AS feature_block, count_if({_ne('v', 'ty')}) AS nonempty_count,
              count_if({_ne('v', 'ty')}) / any_value(t) AS coverage_ratio
       FROM bv JOIN btot USING (split) GROUP BY ALL)
"""


NUMERIC_SQL = BASE + r""",
m AS (
  SELECT split, 'detection.hits' AS metric,
    CASE WHEN json_type(rec, '$.detection_ratio') = 'VARCHAR' THEN
           CASE WHEN contains(json_extract_string(rec, '$.detection_ratio'), '/') THEN
                  CASE WHEN TRY_CAST(trim(split_part(json_extract_string(rec, '$.detection_ratio'), '/', 1)) AS DOUBLE) IS NOT NULL
                        AND TRY_CAST(trim(substr(json_extract_string(rec, '$.detection_ratio'), instr(json_extract_string(rec, '$.detection_ratio'), '/') + 1)) AS DOUBLE) IS NOT NULL
                       THEN TRY_CAST(trim(split_part(json_extract_string(rec, '$.detection_ratio'), '/', 1)) AS DOUBLE) END
                ELSE TRY_CAST(trim(json_extract_string(rec, '$.detection_ratio')) AS DOUBLE) END
         WHEN json_type(rec, '$.detection_ratio') IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(json_extract_string(rec, '$.detection_ratio') AS DOUBLE) END AS x
  FROM recs
  UNION ALL
  SELECT split, 'detection.total',
    CASE WHEN json_type(rec, '$.detection_ratio') = 'VARCHAR' AND contains(json_extract_string(rec, '$.detection_ratio'), '/')
          AND TRY_CAST(trim(split_part(json_extract_string(rec, '$.detection_ratio'), '/', 1)) AS DOUBLE) IS NOT NULL
         THEN TRY_CAST(trim(substr(json_extract_string(rec, '$.detection_ratio'), instr(json_extract_string(rec, '$.detection_ratio'), '/') + 1)) AS DOUBLE) END
  FROM recs
  UNION ALL
  SELECT r.split, p.metric,
    CASE WHEN json_type(r.rec, p.path) IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(json_extract_string(r.rec, p.path) AS DOUBLE)
         WHEN json_type(r.rec, p.path) = 'BOOLEAN' THEN CASE WHEN json_extract_string(r.rec, p.path) = 'true' THEN 1.0 ELSE 0.0 END
         WHEN json_type(r.rec, p.path) = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string(r.rec, p.path)) AS DOUBLE) END
  FROM recs r, (VALUES ('general.size', '$.general.size'), ('general.vsize', '$.general.vsize'),
                       ('general.entropy', '$.general.entropy'), ('general.is_pe', '$.general.is_pe'),
                       ('strings.numstrings', '$.strings.numstrings'), ('strings.avlength', '$.strings.avlength'),
                       ('strings.printables', '$.strings.printables'), ('imports.num_dlls', '$.imports.num_dlls'),
                       ('imports.num_funcs', '$.imports.num_funcs')) p(metric, path))
SELECT split, metric, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max
FROM m GROUP BY ALL
"""

ORACLE = {
    "src_jsonl": f"""
WITH lines AS ({record_sql('duckdb')})
SELECT split, count(*) AS n_lines, count_if(json_valid(value)) AS n_records FROM lines WHERE trim(value) <> '' GROUP BY split""",
    "src_rowcount": f"""
WITH lines AS ({record_sql('duckdb')})
SELECT file_name, count(*) AS n_rows FROM lines WHERE trim(value) <> '' GROUP BY file_name""",
    "src_parse_filename": f"""
WITH lines AS ({record_sql('duckdb')}),
names AS (SELECT file_name AS name FROM lines UNION SELECT 'x_' || file_name FROM lines)
SELECT name,
  CASE WHEN regexp_matches(name, '{FNP}') THEN regexp_extract(name, '{FNP}', 1) END AS week_start,
  CASE WHEN regexp_matches(name, '{FNP}') THEN regexp_extract(name, '{FNP}', 2) END AS week_end,
  CASE WHEN regexp_matches(name, '{FNP}') THEN regexp_extract(name, '{FNP}', 3) END AS file_type_from_name,
  CASE WHEN regexp_matches(name, '{FNP}') THEN regexp_extract(name, '{FNP}', 4) END AS subset_from_name,
  CAST(regexp_matches(name, '{FNP}') AS INTEGER) AS valid_name_pattern
FROM names""",
    "src_split_from_path": f"""
WITH lines AS ({record_sql('duckdb')}),
paths AS (SELECT '/Data/' || upper(split) || '/' || file_name AS path FROM lines
          UNION SELECT '/data/x' || split || '/' || file_name FROM lines)
SELECT path, CASE WHEN list_contains(string_split(lower(path), '/'), 'train') THEN 'train'
                  WHEN list_contains(string_split(lower(path), '/'), 'test') THEN 'test'
                  WHEN list_contains(string_split(lower(path), '/'), 'challenge') THEN 'challenge'
                  ELSE 'unknown' END AS split FROM paths""",
    "agg_bad_rows": BASE + "SELECT split, count_if(rec IS NULL) AS bad_json_rows FROM parsed GROUP BY split",
    "agg_file_overview": f"""
WITH lines AS ({record_sql('duckdb')}),
files AS (SELECT split, file_name, sum(octet_length(encode(value)) + 1) AS size_bytes FROM lines GROUP BY ALL)
SELECT split, count(*) AS n_files, sum(size_bytes) AS total_size_bytes,
  min(regexp_extract(file_name, '{FNP}', 1)) AS first_week, max(regexp_extract(file_name, '{FNP}', 2)) AS last_week,
  count(DISTINCT regexp_extract(file_name, '{FNP}', 3)) AS n_file_types
FROM files GROUP BY split""",
    "agg_split_overview": BASE + """
SELECT split, count(DISTINCT file_name) AS n_files, count(*) AS n_records, count_if(label_num = 1) AS n_malware,
  count_if(label_num = 0) AS n_benign, count_if(label_num = 1) / count(*) AS malware_ratio,
  min(week) AS first_week, max(week) AS last_week, count(DISTINCT week) AS n_unique_weeks,
  count(DISTINCT file_type) AS n_unique_file_types
FROM recs GROUP BY split""",
    "agg_label_dist": BASE + """
SELECT split, label_s AS label, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY split) AS ratio
FROM recs GROUP BY split, label_s""",
    "agg_label_pivot": BASE + """
SELECT split, count_if(label_s = '-1') AS "n_label_-1", count_if(label_s = '0') AS n_label_0,
       count_if(label_s = '1') AS n_label_1, count_if(label_s IS NULL) AS n_label_null FROM recs GROUP BY split""",
    "agg_filetype_dist": BASE + """
SELECT * FROM (SELECT split, file_type, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY split) AS ratio,
  row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, file_type ASC NULLS LAST) AS rank
  FROM recs GROUP BY split, file_type)""",
    "agg_week_timeline": BASE + "SELECT split, week, count(*) AS count FROM recs GROUP BY split, week",
    "agg_week_type_pivot": BASE + """
SELECT split, week, """ + ", ".join(f"count_if(file_type = '{t}') AS \"{t}\"" for t in WEEK_TYPES) + """
FROM recs WHERE week IS NOT NULL AND file_type IS NOT NULL GROUP BY split, week""",
    "agg_field_coverage": BASE + f"""
, kv AS (SELECT r.split, e.k AS field, e.v, e.ty FROM recs r, json_each(r.rec) {EACH.format(a='e')}),
tot AS (SELECT split, count(*) AS t FROM recs GROUP BY split)
SELECT kv.split, field, count(*) AS nonempty_count, count(*) / any_value(t) AS coverage_ratio
FROM kv JOIN tot USING (split) WHERE {_ne('v', 'ty')} GROUP BY kv.split, field""",
    "agg_block_coverage": BASE + _block_cov_cte() + "SELECT * FROM bc",
    "agg_numeric_summary": NUMERIC_SQL,
    "agg_stage2_summary": STAGE2_SUMMARY_SQL,
    "agg_stage2_topvalues": TOPVALUES_SQL,
    "agg_support_audit": SUPPORT_SQL,
    "agg_shape_dist": SHAPE_SQL,
    "agg_examples": EXAMPLES_SQL,
    "prj_project_findings": BASE + _block_cov_cte() + "," + _targets_cte(S2)[1:] + STAGE2_SUMMARY_BODY + """
, s2 AS (SELECT b.split, b.field, present_count / malware_records AS cov FROM base b),
tb AS (SELECT split, string_agg(printf('%s (%.2f%%)', feature_block, coverage_ratio * 100), ', ' ORDER BY r) AS top_blocks
       FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY coverage_ratio DESC, feature_block ASC) AS r FROM bc)
       WHERE r <= 5 GROUP BY split),
best AS (SELECT split, printf('%s (%.2f%%)', field, coalesce(cov, 0.0) * 100) AS top_stage2_target FROM
         (SELECT *, row_number() OVER (PARTITION BY split ORDER BY cov DESC NULLS LAST, field ASC) AS r FROM s2) WHERE r = 1)
SELECT tb.split, top_blocks, top_stage2_target FROM tb LEFT JOIN best USING (split)""",
    "flt_malware_only": BASE + "SELECT split, count(*) AS n_malware FROM recs WHERE label_num = 1 GROUP BY split",
    "prj_nested_get": BASE + """
SELECT doc_id,
  CASE WHEN json_type(rec, '$.general.size') IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(json_extract_string(rec, '$.general.size') AS DOUBLE) END AS general_size,
  CASE WHEN json_type(rec, '$.strings.numstrings') IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(json_extract_string(rec, '$.strings.numstrings') AS DOUBLE) END AS numstrings,
  CASE WHEN json_type(rec, '$.header.coff.timestamp') IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(json_extract_string(rec, '$.header.coff.timestamp') AS DOUBLE) END AS coff_timestamp,
  CASE WHEN json_type(rec, '$.family.x') IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(json_extract_string(rec, '$.family.x') AS DOUBLE) END AS family_x
FROM recs""",
    "prd_nonempty": BASE + f"""
, fv AS (SELECT f.field, json_extract(r.rec, '$."' || f.field || '"') AS v, json_type(r.rec, '$."' || f.field || '"') AS ty
  FROM recs r, (VALUES ('label'), ('family'), ('family_confidence'), ('behavior'), ('packer'), ('group'), ('strings'),
                       ('histogram'), ('imports'), ('exports'), ('header'), ('file_property')) f(field))
SELECT field, count_if({_ne('v', 'ty')}) AS nonempty_count, count(*) AS n FROM fv GROUP BY field""",
    "prj_value_shape": BASE + f"""
SELECT r.split, e.k AS field, {_shape('e.ty')} AS shape, count(*) AS count
FROM recs r, json_each(r.rec) {EACH.format(a='e')} GROUP BY ALL""",
    "prj_detection_ratio": BASE + r"""
, d AS (SELECT doc_id, json_type(rec, '$.detection_ratio') AS ty, json_extract_string(rec, '$.detection_ratio') AS s FROM recs),
p AS (SELECT doc_id, ty, s, TRY_CAST(trim(split_part(s, '/', 1)) AS DOUBLE) AS l,
             TRY_CAST(trim(substr(s, instr(s, '/') + 1)) AS DOUBLE) AS r FROM d)
SELECT doc_id,
  CASE WHEN ty = 'VARCHAR' AND contains(s, '/') THEN CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN l END
       WHEN ty = 'VARCHAR' THEN TRY_CAST(trim(s) AS DOUBLE)
       WHEN ty IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(s AS DOUBLE) END AS hits,
  CASE WHEN ty = 'VARCHAR' AND contains(s, '/') AND l IS NOT NULL AND r IS NOT NULL THEN r END AS total
FROM p""",
}

_NORM_FIELDS = ["behavior", "packer", "group", "family_confidence"]
ORACLE["prj_normalize_labels"] = (BASE + _targets_cte(_NORM_FIELDS).replace("WHERE r.label_num = 1", "")
                                  + """
, allrows AS (SELECT DISTINCT doc_id, field FROM tgt)
SELECT a.doc_id, a.field, coalesce(string_agg(l.value, '|' ORDER BY l.value), '') AS labels
FROM allrows a LEFT JOIN labs l USING (doc_id, field) GROUP BY a.doc_id, a.field""")
ORACLE["prj_read_label"] = f"""
WITH lines AS ({record_sql('duckdb')})
SELECT doc_id, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.label') END AS label,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.family') END AS family
FROM lines WHERE trim(value) <> ''"""


def q_srt_reports(spark, sf):
    """``srt_reports``: a sorted audit table (sorting happens at the sink only)."""
    return au.label_distribution(_recs(spark, sf)).orderBy("split", "label")


QUERIES["srt_reports"] = q_srt_reports
ORACLE["srt_reports"] = ORACLE["agg_label_dist"]
