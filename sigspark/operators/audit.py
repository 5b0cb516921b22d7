"""Dataset audit over raw JSON records (the notebook counters as DataFrames).

``parse_records`` parses every line once into VARIANT; each report below is
one aggregation over that frame (persist it when several reports run).
All groupings are keyed by (split, small dimension), so partial aggregation
collapses rows map-side and the shuffle carries only the counters.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonval as jv

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): splits, layer-2 targets, support
# fields, feature blocks and the numeric metrics with their key paths.
# ---------------------------------------------------------------------------
EXPECTED_SPLITS = ["train", "test", "challenge"]
STAGE2_TARGETS = ["family", "behavior", "file_property", "packer", "exploit", "group"]
SUPPORT_FIELDS = ["family_confidence"]
FEATURE_BLOCKS = ["histogram", "byteentropy", "strings", "general", "header", "section",
                  "imports", "exports", "datadirectories", "richheader", "authenticode",
                  "pefilewarnings"]
NUMERIC_PATHS = {
    "general.size": ("general", "size"),
    "general.vsize": ("general", "vsize"),
    "general.entropy": ("general", "entropy"),
    "general.is_pe": ("general", "is_pe"),
    "strings.numstrings": ("strings", "numstrings"),
    "strings.avlength": ("strings", "avlength"),
    "strings.printables": ("strings", "printables"),
    "imports.num_dlls": ("imports", "num_dlls"),
    "imports.num_funcs": ("imports", "num_funcs"),
}
FILENAME_PATTERN = r"^(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_(.+)_(train|test|challenge)\.jsonl$"

_NUMERIC_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"]


# ---- file names -----------------------------------------------------------------------------

def parse_filename(name: Column) -> Column:
    """``src_parse_filename``: week start/end, file type, subset and validity of a file name."""
    def g(i):
        return F.when(name.rlike(FILENAME_PATTERN), F.regexp_extract(name, FILENAME_PATTERN, i))
    return F.struct(
        g(1).alias("week_start"), g(2).alias("week_end"), g(3).alias("file_type_from_name"),
        g(4).alias("subset_from_name"), F.coalesce(name.rlike(FILENAME_PATTERN), F.lit(False)).alias("valid_name_pattern"))


def split_from_path(path: Column) -> Column:
    """``src_split_from_path``: first expected split among the lower-cased path parts."""
    parts = F.split(F.lower(path), "/")
    expr = F.lit("unknown")
    for s in reversed(EXPECTED_SPLITS):
        expr = F.when(F.array_contains(parts, s), s).otherwise(expr)
    return expr


# ---- parsing --------------------------------------------------------------------------------

def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Non-blank lines parsed to ``rec VARIANT`` (NULL for a malformed line),
    plus the fields every report needs."""
    fn = parse_filename(F.col("file_name")) if "file_name" in lines.columns else None
    df = lines.where(F.col(value).rlike(r"\S")).withColumn("rec", F.try_parse_json(F.col(value)))
    if fn is not None:
        df = df.withColumn("fn", fn)
    return df


def records(parsed: DataFrame) -> DataFrame:
    """Good records with label / file type / week resolved (record value, else file name)."""
    r = F.col("rec")
    lab = jv.nested_get(r, "label")
    has = lambda k: F.array_contains(F.map_keys(jv.as_object(r)), k)
    ft_name = F.col("fn.file_type_from_name") if "fn" in parsed.columns else F.lit(None).cast("string")
    wk_name = F.col("fn.week_start") if "fn" in parsed.columns else F.lit(None).cast("string")
    return (parsed.where(r.isNotNull())
            .withColumn("label_v", lab)
            .withColumn("label_s", jv.as_string(lab))
            .withColumn("label_num", F.when(jv.vtype(lab).isin(_NUMERIC_TYPES), jv.as_double(lab)))
            .withColumn("file_type", F.when(has("file_type"), jv.as_string(jv.nested_get(r, "file_type")))
                        .otherwise(ft_name))
            .withColumn("week", F.when(has("week_id"), jv.as_string(jv.nested_get(r, "week_id")))
                        .otherwise(wk_name)))


def bad_rows(parsed: DataFrame) -> DataFrame:
    """``agg_bad_rows``: malformed lines per split (the job continues past them)."""
    return parsed.groupBy("split").agg(F.count_if(F.col("rec").isNull()).alias("bad_json_rows"))


# ---- split-level reports ----------------------------------------------------------------------

def file_overview(lines: DataFrame) -> DataFrame:
    """``agg_file_overview``: per split, files, bytes, first/last week and file types (from names)."""
    files = (lines.groupBy("split", "file_name")
             .agg(F.sum(F.octet_length("value") + 1).alias("size_bytes"))
             .withColumn("fn", parse_filename(F.col("file_name"))))
    return files.groupBy("split").agg(
        F.count("file_name").alias("n_files"),
        F.sum("size_bytes").alias("total_size_bytes"),
        F.min("fn.week_start").alias("first_week"),
        F.max("fn.week_end").alias("last_week"),
        F.countDistinct("fn.file_type_from_name").alias("n_file_types"))


def split_overview(recs: DataFrame) -> DataFrame:
    """``agg_split_overview``."""
    return recs.groupBy("split").agg(
        F.countDistinct("file_name").alias("n_files"),
        F.count("*").alias("n_records"),
        F.count_if(F.col("label_num") == 1).alias("n_malware"),
        F.count_if(F.col("label_num") == 0).alias("n_benign"),
        (F.count_if(F.col("label_num") == 1) / F.count("*")).alias("malware_ratio"),
        F.min("week").alias("first_week"),
        F.max("week").alias("last_week"),
        F.countDistinct("week").alias("n_unique_weeks"),
        F.countDistinct("file_type").alias("n_unique_file_types"))


def _with_split_total(df: DataFrame, recs: DataFrame) -> DataFrame:
    tot = recs.groupBy("split").agg(F.count("*").alias("__total"))
    return df.join(tot, "split").withColumn("ratio", F.col("count") / F.col("__total")).drop("__total")


def label_distribution(recs: DataFrame) -> DataFrame:
    """``agg_label_dist``: (split, label, count, ratio); label as text, NULL when missing."""
    c = recs.groupBy("split", F.col("label_s").alias("label")).agg(F.count("*").alias("count"))
    w = Window.partitionBy("split")
    return c.withColumn("ratio", F.col("count") / F.sum("count").over(w))


def label_pivot(recs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``agg_label_pivot``: split x label counts, 0-filled; one column for each label that occurs
    (``labels`` fixes the columns instead)."""
    d = recs.select("split", F.coalesce(F.col("label_s"), F.lit("null")).alias("__l"))
    counts = d.groupBy("split", "__l").count()
    if labels is None:
        labels = sorted(r[0] for r in counts.select("__l").distinct().collect())
    return counts.groupBy("split").agg(*[
        F.coalesce(F.sum(F.when(F.col("__l") == v, F.col("count"))), F.lit(0)).cast("bigint").alias(f"n_label_{v}") for v in labels])


def filetype_distribution(recs: DataFrame, top: int | None = None) -> DataFrame:
    """``agg_filetype_dist``: file types per split with count, ratio and rank (``top`` of them, for a chart)."""
    c = recs.groupBy("split", "file_type").agg(F.count("*").alias("count"))
    w = Window.partitionBy("split")
    r = Window.partitionBy("split").orderBy(F.col("count").desc(), F.col("file_type").asc_nulls_last())
    ranked = c.withColumn("ratio", F.col("count") / F.sum("count").over(w)).withColumn("rank", F.row_number().over(r))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def week_timeline(recs: DataFrame) -> DataFrame:
    """``agg_week_timeline``: records per (split, week)."""
    return recs.groupBy("split", "week").agg(F.count("*").alias("count"))


def week_type_pivot(recs: DataFrame, file_types: list[str] | None = None) -> DataFrame:
    """``agg_week_type_pivot``: (split, week) x file_type counts, 0-filled; rows with no week or no
    type are left out (as a pandas pivot_table does)."""
    base = recs.where(F.col("week").isNotNull() & F.col("file_type").isNotNull()).groupBy("split", "week", "file_type").count()
    if file_types is None:
        file_types = sorted(r[0] for r in base.select("file_type").distinct().collect())
    return base.groupBy("split", "week").agg(*[
        F.coalesce(F.sum(F.when(F.col("file_type") == t, F.col("count"))), F.lit(0)).cast("bigint").alias(t) for t in file_types])


# ---- coverage ----------------------------------------------------------------------------------

def field_coverage(recs: DataFrame) -> DataFrame:
    """``agg_field_coverage``: non-empty count and ratio per (split, top-level key)."""
    kv = recs.select("split", F.explode(jv.as_object(F.col("rec"))).alias("field", "v"))
    c = kv.where(jv.is_nonempty(F.col("v"))).groupBy("split", "field").agg(F.count("*").alias("nonempty_count"))
    tot = recs.groupBy("split").agg(F.count("*").alias("__t"))
    return (c.join(tot, "split").withColumn("coverage_ratio", F.col("nonempty_count") / F.col("__t"))
             .drop("__t"))


def block_coverage(recs: DataFrame, blocks: list[str] = FEATURE_BLOCKS) -> DataFrame:
    """``agg_block_coverage``: non-empty count per (split, feature block), zero rows
    kept. One conditional aggregate per split, then an unpivot (no cross join)."""
    aggs = [F.count_if(jv.is_nonempty(jv.nested_get(F.col("rec"), b))).alias(f"b{i}") for i, b in enumerate(blocks)]
    wide = recs.groupBy("split").agg(F.count("*").alias("__t"), *aggs)
    pairs = F.array(*[F.struct(F.lit(b).alias("feature_block"), F.col(f"b{i}").alias("nonempty_count"))
                      for i, b in enumerate(blocks)])
    return (wide.select("split", "__t", F.inline(pairs))
                .withColumn("coverage_ratio", F.col("nonempty_count") / F.col("__t")).drop("__t"))


def _to_float(v: Column) -> Column:
    """float(value) or NULL: numbers, booleans and numeric strings."""
    t = jv.vtype(v)
    return (F.when(t.isin(_NUMERIC_TYPES), jv.as_double(v))
             .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
             .when(t == "STRING", F.trim(jv.as_string(v)).try_cast("double")))


def numeric_summary(recs: DataFrame, paths: dict = NUMERIC_PATHS) -> DataFrame:
    """``agg_numeric_summary`` (+ detection hits/total): count, mean, sample std, min, max
    per (split, metric). Unparsable values are skipped; a metric never present keeps a
    row with count 0."""
    r = F.col("rec")
    det = jv.detection_ratio(jv.nested_get(r, "detection_ratio"))
    items = [F.struct(F.lit("detection.hits").alias("metric"), det["hits"].alias("x")),
             F.struct(F.lit("detection.total").alias("metric"), det["total"].alias("x"))]
    items += [F.struct(F.lit(m).alias("metric"), _to_float(jv.nested_get(r, *p)).alias("x"))
              for m, p in paths.items()]
    long = recs.select("split", F.inline(F.array(*items)))
    return long.groupBy("split", "metric").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))


# ---- layer-2 targets on malware rows --------------------------------------------------------

def _target_rows(recs: DataFrame, fields: list[str], keep: list[str] = ()) -> DataFrame:
    mal = recs.where(F.col("label_num") == 1)
    items = F.array(*[F.struct(F.lit(f).alias("field"), jv.nested_get(F.col("rec"), f).alias("v")) for f in fields])
    oid = [] if "doc_id" in recs.columns else [F.lit(None).alias("doc_id")]
    t = mal.select("split", *(["doc_id"] if not oid else oid), *keep, F.inline(items))
    return (t.withColumn("shape", jv.value_shape(F.col("v")))
             .withColumn("present", jv.is_nonempty(F.col("v")))
             .withColumn("labels", jv.normalize_labels(F.col("v"))))


def _value_counts(t: DataFrame) -> DataFrame:
    return (t.select("split", "field", F.explode("labels").alias("value"))
             .groupBy("split", "field", "value").agg(F.count("*").alias("count")))


def _top1(df: DataFrame, keys: list[str], val: str, cnt: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(cnt).desc(), F.col(val).asc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def stage2_summary(recs: DataFrame, fields: list[str] = STAGE2_TARGETS) -> DataFrame:
    """``agg_stage2_summary``: per (split, field) over malware rows: presence, coverage,
    distinct values, dominant raw shape, top-1 value/count/ratio (ties by value)."""
    t = _target_rows(recs, fields)
    base = t.groupBy("split", "field").agg(F.count("*").alias("malware_records"),
                                           F.count_if("present").alias("present_count"))
    shapes = _top1(t.groupBy("split", "field", "shape").agg(F.count("*").alias("n")),
                   ["split", "field"], "shape", "n").select("split", "field", F.col("shape").alias("dominant_raw_shape"))
    vc = _value_counts(t)
    tot = vc.groupBy("split", "field").agg(F.count("*").alias("n_unique_values"), F.sum("count").alias("__sum"))
    top = _top1(vc, ["split", "field"], "value", "count").select(
        "split", "field", F.col("value").alias("top1_value"), F.col("count").alias("top1_count"))
    return (base.join(shapes, ["split", "field"], "left")
                .join(tot, ["split", "field"], "left")
                .join(top, ["split", "field"], "left")
                .select("split", "field", "malware_records", "present_count",
                        (F.col("present_count") / F.col("malware_records")).alias("coverage_in_malware"),
                        F.coalesce("n_unique_values", F.lit(0)).alias("n_unique_values"),
                        "dominant_raw_shape", "top1_value",
                        F.coalesce("top1_count", F.lit(0)).alias("top1_count"),
                        (F.col("top1_count") / F.col("__sum")).alias("top1_ratio_among_present")))


def stage2_top_values(recs: DataFrame, n: int = 20, fields: list[str] = STAGE2_TARGETS) -> DataFrame:
    """``agg_stage2_topvalues``: top n normalised values per (split, field)."""
    vc = _value_counts(_target_rows(recs, fields))
    w = Window.partitionBy("split", "field").orderBy(F.col("count").desc(), F.col("value").asc())
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def support_audit(recs: DataFrame, fields: list[str] = SUPPORT_FIELDS, preview: int = 10) -> DataFrame:
    """``agg_support_audit``: coverage, distinct values, dominant shape and a top-10 preview."""
    s = stage2_summary(recs, fields)
    tv = stage2_top_values(recs, preview, fields)
    prev = (tv.groupBy("split", "field")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("__t"))
              .select("split", "field", F.concat(
                  F.lit("["), F.array_join(F.transform("__t", lambda e: F.format_string("('%s', %d)", e["value"], e["count"])), ", "),
                  F.lit("]")).alias("top_values_preview")))
    return (s.select("split", "field", "malware_records", "present_count", "coverage_in_malware",
                     "n_unique_values", "dominant_raw_shape")
             .join(prev, ["split", "field"], "left")
             .withColumn("top_values_preview", F.coalesce("top_values_preview", F.lit("[]"))))


def shape_distribution(recs: DataFrame, fields: list[str] = STAGE2_TARGETS) -> DataFrame:
    """``agg_shape_dist``: count per (split, field, raw shape) on malware rows."""
    return (_target_rows(recs, fields).groupBy("split", "field", F.col("shape").alias("raw_shape"))
            .agg(F.count("*").alias("count")))


def examples(recs: DataFrame, fields: list[str] = STAGE2_TARGETS + SUPPORT_FIELDS, n: int = 5,
             order_col: str = "doc_id") -> DataFrame:
    """``agg_examples``: first n values with non-empty labels per (split, field), JSON text cut to 300 chars."""
    t = _target_rows(recs, fields, keep=["value"]).where(F.size("labels") > 0)
    w = Window.partitionBy("split", "field").orderBy(F.col(order_col))
    raw = raw_field_text(F.col("value"))
    return (t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
             .select("split", "field", "rank", F.substring(raw[F.col("field")], 1, 300).alias("example")))


def raw_field_text(line: Column) -> Column:
    """Top-level fields of a JSON line as their original text (strings unquoted,
    objects keep their key order); VARIANT would re-order object keys."""
    return F.from_json(line, "map<string,string>")


# ---- previews --------------------------------------------------------------------------------

def record_view(recs: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """``prj_record_view``: for the first record of each split, one row per top-level
    field with its shape and a 200-character preview (objects: first 12 keys and
    length; arrays: length and first 3 elements)."""
    w = Window.partitionBy("split").orderBy(order_col)
    first = recs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
    kv = first.select("split", F.explode(jv.as_object(F.col("rec"))).alias("field", "v"))
    shape = jv.value_shape(F.col("v"))
    obj_keys = F.map_keys(jv.as_object(F.col("v")))
    arr = jv.as_array(F.col("v"))
    prev = (F.when(shape == "dict", F.concat(F.lit("dict keys=["), F.array_join(F.slice(obj_keys, 1, 12), ", "),
                                              F.lit("] len="), F.size(obj_keys).cast("string")))
             .when(shape == "list", F.concat(F.lit("list len="), F.size(arr).cast("string"), F.lit(" sample="),
                                             F.to_json(F.slice(arr, 1, 3))))
             .otherwise(F.to_json(F.col("v"))))
    return kv.select("split", "field", shape.alias("python_type"), F.substring(prev, 1, 200).alias("preview"))


def raw_preview(recs: DataFrame, n: int = 5, order_col: str = "doc_id") -> DataFrame:
    """``prj_raw_preview``: first n records per split, 12 fields and 5 has-block flags."""
    w = Window.partitionBy("split").orderBy(order_col)
    r = F.col("rec")
    top = recs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    fields = ["md5", "sha256", "label", "file_type", "family", "family_confidence", "behavior",
              "file_property", "packer", "exploit", "group", "week_id"]
    cols = [F.to_json(jv.nested_get(r, f)).alias(f) for f in fields]
    flags = [jv.is_nonempty(jv.nested_get(r, b)).alias(f"has_{b}") for b in ["general", "strings", "header", "section", "imports"]]
    return top.select("split", "rank", *cols, *flags)


def project_findings(recs: DataFrame, topn: int = 5) -> DataFrame:
    """``prj_project_findings``: per split, the top blocks by coverage as
    "name (xx.xx%)" text and the top layer-2 target by coverage."""
    bc = block_coverage(recs)
    w = Window.partitionBy("split").orderBy(F.col("coverage_ratio").desc(), F.col("feature_block").asc())
    top_blocks = (bc.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= topn)
                  .groupBy("split").agg(F.sort_array(F.collect_list(F.struct(
                      "__r", F.format_string("%s (%.2f%%)", F.col("feature_block"), F.col("coverage_ratio") * 100).alias("t")))).alias("__l"))
                  .select("split", F.array_join(F.transform("__l", lambda e: e["t"]), ", ").alias("top_blocks")))
    s2 = stage2_summary(recs)
    w2 = Window.partitionBy("split").orderBy(F.col("coverage_in_malware").desc_nulls_last(), F.col("field").asc())
    best = (s2.withColumn("__r", F.row_number().over(w2)).where(F.col("__r") == 1)
            .select("split", F.format_string("%s (%.2f%%)", F.col("field"),
                                             F.coalesce(F.col("coverage_in_malware"), F.lit(0.0)) * 100).alias("top_stage2_target")))
    return top_blocks.join(best, "split", "left")
