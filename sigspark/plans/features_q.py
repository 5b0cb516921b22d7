"""Registered featurisation queries over the driver tables.

File bytes are stood in by ``encode(documents.text, 'UTF-8')`` and
``encode(pages.html, 'UTF-8')``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as fb
from ..functions import strings as fs
from ..operators.profile import byte_profile
from ..sources.tables import table


def doc_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", F.encode("text", "UTF-8").alias("content"))


def page_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("content"))


def q_byte_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: per source, file count, bytes, mean byte entropy, strings and printables."""
    p = byte_profile(doc_bytes(spark, sf))
    return (p.groupBy("source").agg(
        F.count("*").alias("n_files"),
        F.sum(F.col("general.size")).alias("total_bytes"),
        F.round(F.avg(F.col("general.entropy")), 6).alias("avg_entropy"),
        F.sum(F.col("pstats.numstrings")).alias("numstrings"),
        F.sum(F.col("pstats.printables")).alias("printables"),
    ))


BYTE_SUMMARY_SQL = """
WITH b AS (SELECT doc_id, source, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
bytes AS (SELECT doc_id, source, n, substr(h, 2*i+1, 2) AS byte FROM b, range(n) t(i)),
hist AS (SELECT doc_id, source, n, byte, count(*) AS c FROM bytes GROUP BY ALL),
ent AS (SELECT doc_id, source, n, -sum(c / n * log2(c / n)) AS e FROM hist GROUP BY ALL),
st AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x20-\\x7f]{5,}')) AS ns,
              list_sum(list_transform(regexp_extract_all(text, '[\\x20-\\x7f]{5,}'), lambda s: length(s))) AS np
       FROM documents)
SELECT source, count(*) AS n_files, sum(n) AS total_bytes, round(avg(e), 6) AS avg_entropy,
       sum(ns) AS numstrings, sum(coalesce(np, 0)) AS printables
FROM ent JOIN st USING (doc_id) GROUP BY source
"""

QUERIES = {
    "ft_byte_summary": q_byte_summary,
}

ORACLE = {
    "ft_byte_summary": BYTE_SUMMARY_SQL,
}


# ---------------------------------------------------------------------------------------------
# Byte-level blocks on the document bytes (and pages for the string indicators)
# ---------------------------------------------------------------------------------------------

def q_ft_sha256(spark, sf):
    return doc_bytes(spark, sf).select("doc_id", F.sha2("content", 256).alias("sha256"))


def q_ft_general(spark, sf):
    p = byte_profile(doc_bytes(spark, sf))
    g = F.col("general")
    return p.select("doc_id", g["size"].alias("size"), F.round(g["entropy"], 6).alias("entropy"),
                    g["is_pe"].alias("is_pe"), *[g["start_bytes"][i].alias(f"b{i}") for i in range(4)])


def q_agg_byte_stats(spark, sf):
    p = byte_profile(doc_bytes(spark, sf))
    return p.select("doc_id", F.col("general.size").alias("size"), F.round("general.entropy", 6).alias("entropy"))


def q_ft_byte_histogram(spark, sf):
    p = byte_profile(doc_bytes(spark, sf))
    h = F.col("histogram")
    v = fb.normalize_counts(h)
    return p.select("doc_id", F.size(F.filter(h, lambda x: x > 0)).alias("n_values"), F.array_max(h).alias("max_count"),
                    h[0x20].alias("n_space"), h[0x65].alias("n_e"), F.round(v[0x65].cast("double"), 6).alias("p_e"))


def q_ft_byte_entropy(spark, sf):
    p = page_bytes(spark, sf).withColumn("be", fb.byte_entropy_histogram_udf(F.col("content")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.aggregate(F.slice("be", r * 16 + 1, 16), F.lit(0).cast("bigint"), lambda a, x: a + x))
    t = p.select("page_id", F.posexplode(rows).alias("hbin", "n"))
    return t.where("n > 0").select("page_id", "hbin", "n")


def q_ft_strings(spark, sf):
    p = byte_profile(page_bytes(spark, sf))
    s = F.col("pstats")
    return p.select("page_id", s["numstrings"].alias("numstrings"), F.round(s["avlength"], 6).alias("avlength"),
                    s["printables"].alias("printables"), F.round(s["entropy"], 3).alias("entropy"))


def q_ft_string_iocs(spark, sf):
    p = fs.with_ioc_counts(page_bytes(spark, sf), "content", "c")
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col("c")[n].alias("count")) for n, _, _ in fs.IOC_PATTERNS])
    return p.select("page_id", F.inline(items)).where("count > 0")


def q_ft_strings_vec(spark, sf):
    from ..functions.pe import strings_vec
    from ..operators.profile import strings_block
    p = byte_profile(page_bytes(spark, sf), with_iocs=True).withColumn("s", strings_block())
    v = strings_vec(F.col("s"))
    dist = F.slice(v, 4, 96)
    iocs = F.slice(v, 101, 77)
    return p.select("page_id", F.size(v).alias("dim"),
                    F.round(F.aggregate(dist, F.lit(0.0).cast("double"), lambda a, x: a + x), 5).alias("dist_sum"),
                    F.aggregate(iocs, F.lit(0.0).cast("double"), lambda a, x: a + x).alias("ioc_sum"),
                    F.aggregate(F.transform(iocs, lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x).alias("ioc_wsum"))


def q_fn_entropy(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    e = d.groupBy("source").agg(F.collect_list("n").alias("counts"))
    return e.select("source", F.round(fb.entropy_from_counts(F.col("counts")), 6).alias("entropy"))


def q_ft_vector_assemble(spark, sf):
    """Full 2568-wide vectors: byte blocks from the document bytes, PE blocks from the
    stand-in record (Murmur3 hashing); reported as width and block sums."""
    from ..operators.featurize import vectorize_bytes_and_record
    v = vectorize_bytes_and_record(spark, sf)
    return v.select("doc_id", F.size("features").alias("dim"),
                    F.round(F.aggregate(F.slice("features", 8, 256), F.lit(0.0).cast("double"), lambda a, x: a + x), 4).alias("hist_sum"))


QUERIES.update({
    "ft_sha256": q_ft_sha256,
    "ft_general": q_ft_general,
    "agg_byte_stats": q_agg_byte_stats,
    "ft_byte_histogram": q_ft_byte_histogram,
    "ft_byte_entropy": q_ft_byte_entropy,
    "ft_strings": q_ft_strings,
    "ft_string_iocs": q_ft_string_iocs,
    "ft_strings_iocs": q_ft_string_iocs,
    "ft_strings_vec": q_ft_strings_vec,
    "fn_entropy": q_fn_entropy,
    "ft_vector_assemble": q_ft_vector_assemble,
})

_DOC_BYTES = """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
bytes AS (SELECT doc_id, n, substr(h, 2*i+1, 2) AS byte FROM b, range(n) t(i)),
hist AS (SELECT doc_id, n, byte, count(*) AS c FROM bytes GROUP BY ALL),
ent AS (SELECT doc_id, any_value(n) AS n, -sum(c / n * log2(c / n)) AS e, count(*) AS nv, max(c) AS mx,
               coalesce(max(CASE WHEN byte = '20' THEN c END), 0) AS n_space, coalesce(max(CASE WHEN byte = '65' THEN c END), 0) AS n_e
        FROM hist GROUP BY doc_id)
"""

_PAGE_STRINGS = """
WITH s AS (SELECT page_id, regexp_extract_all(html, '[\\x20-\\x7f]{5,}') AS strs FROM pages),
ch AS (SELECT page_id, unnest(string_split(array_to_string(strs, ''), '')) AS c FROM s),
cc AS (SELECT page_id, c, count(*) AS k FROM ch GROUP BY ALL),
cc2 AS (SELECT page_id, k, sum(k) OVER (PARTITION BY page_id) AS tot FROM cc),
ce AS (SELECT page_id, -sum(k / tot * log2(k / tot)) AS e FROM cc2 GROUP BY page_id)
"""


def _duck_pattern(p: str, ci: bool) -> str:
    return (("(?i)" if ci else "") + p).replace("'", "''")


_IOC_VALUES = ",\n".join(f"('{n}', '{_duck_pattern(p, ci)}')" for n, p, ci in fs.IOC_PATTERNS)

ORACLE.update({
    "ft_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "ft_general": _DOC_BYTES + """
, first4 AS (SELECT doc_id, h FROM b)
SELECT e.doc_id, e.n AS size, round(e.e, 6) AS entropy, 0 AS is_pe,
  CAST(('0x' || substr(h, 1, 2))::INTEGER AS INTEGER) AS b0,
  CASE WHEN e.n >= 2 THEN CAST(('0x' || substr(h, 3, 2))::INTEGER AS INTEGER) ELSE 0 END AS b1,
  CASE WHEN e.n >= 3 THEN CAST(('0x' || substr(h, 5, 2))::INTEGER AS INTEGER) ELSE 0 END AS b2,
  CASE WHEN e.n >= 4 THEN CAST(('0x' || substr(h, 7, 2))::INTEGER AS INTEGER) ELSE 0 END AS b3
FROM ent e JOIN first4 USING (doc_id)""",
    "agg_byte_stats": _DOC_BYTES + "SELECT doc_id, n AS size, round(e, 6) AS entropy FROM ent",
    "ft_byte_histogram": _DOC_BYTES + """
SELECT doc_id, CAST(nv AS INTEGER) AS n_values, mx AS max_count, n_space, n_e, round(CAST(CAST(n_e AS FLOAT) / CAST(n AS FLOAT) AS DOUBLE), 6) AS p_e FROM ent""",
    "ft_strings": _PAGE_STRINGS + """
SELECT s.page_id, len(strs) AS numstrings,
  round(CASE WHEN len(strs) > 0 THEN list_sum(list_transform(strs, lambda x: length(x))) / len(strs) ELSE 0 END, 6) AS avlength,
  coalesce(list_sum(list_transform(strs, lambda x: length(x))), 0) AS printables, round(coalesce(ce.e, 0), 3) AS entropy
FROM s LEFT JOIN ce USING (page_id)""",
    "ft_string_iocs": f"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '[\\x20-\\x7f]{{5,}}')) AS str FROM pages),
p AS (SELECT * FROM (VALUES {_IOC_VALUES}) t(name, pat))
SELECT s.page_id, p.name, count(*) AS count FROM s, p WHERE regexp_matches(s.str, p.pat) GROUP BY ALL""",
    "ft_strings_vec": f"""
WITH s AS (SELECT page_id, regexp_extract_all(html, '[\\x20-\\x7f]{{5,}}') AS strs FROM pages),
u AS (SELECT page_id, unnest(strs) AS str FROM s),
p AS (SELECT * FROM (VALUES {",".join(f"('{n}', '{_duck_pattern(pt, ci)}', {i})" for i, (n, pt, ci) in enumerate(sorted(fs.IOC_PATTERNS)))}) t(name, pat, slot)),
m AS (SELECT u.page_id, p.slot, count(*) AS c FROM u, p WHERE regexp_matches(u.str, p.pat) GROUP BY ALL),
agg AS (SELECT page_id, sum(c) AS ioc_sum, sum(c * (slot + 1)) AS ioc_wsum FROM m GROUP BY page_id)
SELECT s.page_id, 177 AS dim, CASE WHEN len(strs) > 0 THEN 1.0 ELSE 0.0 END AS dist_sum,
       coalesce(ioc_sum, 0) AS ioc_sum, coalesce(ioc_wsum, 0) AS ioc_wsum
FROM s LEFT JOIN agg USING (page_id)""",
    "fn_entropy": """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
c2 AS (SELECT source, n, sum(n) OVER (PARTITION BY source) AS t FROM c)
SELECT source, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM c2 GROUP BY source""",
})
ORACLE["ft_strings_iocs"] = ORACLE["ft_string_iocs"]

ORACLE["ft_byte_entropy"] = """
WITH b AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages),
nb AS (SELECT page_id, n, i, ('0x' || substr(h, 2*i+1, 1))::INTEGER AS nib FROM b, range(n) t(i)),
w AS (SELECT page_id, unnest(CASE WHEN n < 2048 THEN [0] ELSE range(0, n - 2048 + 1, 1024) END) AS ws FROM b),
cand AS (SELECT page_id, nib, unnest([(i // 1024) * 1024, (i // 1024) * 1024 - 1024]) AS ws FROM nb),
cnt AS (SELECT cand.page_id, cand.ws, nib, count(*) AS c FROM cand JOIN w ON cand.page_id = w.page_id AND cand.ws = w.ws GROUP BY ALL),
ent AS (SELECT page_id, ws, -sum(CAST(c AS FLOAT) / 2048.0 * log2(CAST(c AS FLOAT) / 2048.0)) * 2 AS hh, sum(c) AS tot FROM cnt GROUP BY ALL)
SELECT page_id, CAST(least(floor(hh * 2), 15) AS INTEGER) AS hbin, sum(tot) AS n FROM ent GROUP BY ALL
"""
ORACLE["ft_vector_assemble"] = _DOC_BYTES + """
SELECT doc_id, 2568 AS dim, 1.0 AS hist_sum FROM ent"""

QUERIES["ft_assemble"] = q_ft_vector_assemble
ORACLE["ft_assemble"] = ORACLE["ft_vector_assemble"]
