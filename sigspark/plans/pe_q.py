"""Registered PE-block queries over the document-derived PE record (see
``sources.pe_standin``): English documents are PE files, the rest non-PE.

Vectors are reported as per-row checksums s1 = sum(v), s2 = sum((i+1) * v),
which the DuckDB oracles recompute from the stand-in rules and the block
layouts; hashed blocks are checked in the SQL-reproducible md5 mode.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import pe
from ..functions.warnings import CATALOGUE, PREFIXES, SUFFIXES
from ..sources import pe_standin as ps
from ..sources.tables import table


def _sums(v: Column):
    s1 = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x)
    s2 = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.round(s1, 3).alias("s1"), F.round(s2, 3).alias("s2")


def _vec_sums(r, v: Column):
    """(doc_id, s1, s2) of a vector that is made once: as a column it is not evaluated again for each sum."""
    return r.select("doc_id", v.alias("v")).select("doc_id", *_sums(F.col("v")))


def _recs(spark, sf):
    return ps.pe_records(spark, sf)


def q_ft_header_vec(spark, sf):
    return _vec_sums(_recs(spark, sf), pe.header_vec(F.col("raw.header")))


def q_ft_datadirs_vec(spark, sf):
    return _vec_sums(_recs(spark, sf), pe.datadirectories_vec(F.col("raw.datadirectories")))


def q_ft_authenticode_vec(spark, sf):
    return _vec_sums(_recs(spark, sf), pe.authenticode_vec(F.col("raw.authenticode")))


def q_ft_warning_normalize(spark, sf):
    return _recs(spark, sf).select("doc_id", F.array_join(F.col("raw.pefilewarnings"), "|").alias("warnings"))


def q_ft_warning_vec(spark, sf):
    return _vec_sums(_recs(spark, sf), pe.warnings_vec(F.col("raw.pefilewarnings")))


def q_ft_exports_vec(spark, sf):
    return _vec_sums(_recs(spark, sf), pe.exports_vec(F.col("raw.exports"), mode="md5"))


def q_ft_section_stats(spark, sf):
    st = pe.section_stats(F.col("raw.section"))
    names = ["n_sections", "n_zero_size", "n_empty_name", "n_rx", "n_w", "max_entropy", "min_entropy",
             "max_size_ratio", "min_size_ratio", "max_vsize_ratio", "min_vsize_ratio"]
    # the row number keeps the filter above the parsed record: pushed below it, it would parse every record twice
    r = (_recs(spark, sf).select("doc_id", F.col("raw.section").isNotNull().alias("has"), st.alias("st"), F.monotonically_increasing_id().alias("at"))
         .where(F.col("has") & (F.col("at") >= 0)))
    return r.select(
        "doc_id", *[F.round(F.col("st")[i].cast("double"), 4).alias(n) for i, n in enumerate(names)])


def q_ft_zero_block(spark, sf):
    r = _recs(spark, sf)
    blocks = {"header": pe.header_vec(F.col("raw.header")), "datadirectories": pe.datadirectories_vec(F.col("raw.datadirectories")),
              "authenticode": pe.authenticode_vec(F.col("raw.authenticode")),
              "pefilewarnings": pe.warnings_vec(F.col("raw.pefilewarnings")),
              "exports": pe.exports_vec(F.col("raw.exports"), mode="md5")}
    return r.agg(*[F.count_if(F.forall(v, lambda x: x == 0)).alias(f"zero_{b}") for b, v in blocks.items()])


def q_ft_block_subset(spark, sf):
    r = _recs(spark, sf)
    v = pe.assemble(r, "raw", ["header", "datadirectories", "authenticode"], mode="md5")
    return v.select("doc_id", F.size("features").alias("dim"), *_sums(F.col("features")))


def q_fn_feature_hash(spark, sf):
    """Murmur3 feature hashing of the document words (1024 unsigned buckets)."""
    d = table(spark, sf, "documents").select("doc_id", ps.words(F.col("text")).alias("w"))
    h = d.withColumn("h", hs.feature_hash_strings(F.col("w"), 1024, False))
    return h.select("doc_id", F.size("w").alias("n_words"), F.round(F.aggregate("h", F.lit(0.0).cast("double"), lambda a, x: a + x), 3).alias("s1"))


QUERIES = {
    "ft_header_vec": q_ft_header_vec,
    "ft_datadirs_vec": q_ft_datadirs_vec,
    "ft_authenticode_vec": q_ft_authenticode_vec,
    "ft_warning_normalize": q_ft_warning_normalize,
    "ft_warning_vec": q_ft_warning_vec,
    "ft_exports_vec": q_ft_exports_vec,
    "ft_section_stats": q_ft_section_stats,
    "ft_zero_block": q_ft_zero_block,
    "ft_block_subset": q_ft_block_subset,
    "fn_feature_hash": q_fn_feature_hash,
}

# ---- DuckDB oracles -----------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(idx: str, values: list) -> str:
    parts = " ".join(f"WHEN {idx} = {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"(CASE {parts} ELSE {values[-1]} END)"


def _header_slots() -> list[str]:
    mach = [pe.MACHINE_TYPES.index(m) if m in pe.MACHINE_TYPES else 0 for m in ps.MACHINE_BY_MOD4]
    sub = [pe.SUBSYSTEM_TYPES.index(m) if m in pe.SUBSYSTEM_TYPES else 0 for m in ps.SUBSYSTEM_BY_MOD3]
    slots = ["n_chars", "(doc_id % 7 + 1)", "0", "224", "0", _case("doc_id % 4", mach), _case("doc_id % 3", sub)]
    slots += ["4194304" if f == "image_base" else f"((n_chars + {j}) % 97)" for j, f in enumerate(pe.OPTIONAL_SCALARS)]
    for c in pe.IMAGE_CHARACTERISTICS:
        slots.append(_case("doc_id % 3", [1 if c in ch else 0 for ch in ps.CHARS_BY_MOD3]))
    for c in pe.DLL_CHARACTERISTICS:
        slots.append(f"(CASE WHEN doc_id % 2 = 0 AND {1 if c in ('NX_COMPAT', 'DYNAMIC_BASE') else 0} = 1 THEN 1 ELSE 0 END)")
    for j, m in enumerate(pe.DOS_MEMBERS):
        slots.append("23117" if m == "e_magic" else "128" if m == "e_lfanew" else f"((doc_id + {j}) % 13)")
    assert len(slots) == 74
    return slots


def _datadir_slots() -> list[str]:
    slots = []
    for j, _ in enumerate(pe.DATA_DIRECTORY_NAMES):
        if j < len(pe.DATA_DIRECTORY_NAMES) - 1:
            slots += [f"(n_chars % {j + 7})", str(j * 4096)]
        else:
            slots += ["0", "0"]  # the last directory is skipped (compat)
    return slots + ["(doc_id % 2)", "0"]


def _auth_slots() -> list[str]:
    return ["(doc_id % 3)", "(doc_id % 2)", "0", "((doc_id + 1) % 2)", "0", "(doc_id % 4)", "n_chars", "(n_chars - 100)"]


def _sums_sql(slots: list[str]) -> str:
    s1 = " + ".join(f"CAST({e} AS DOUBLE)" for e in slots)
    s2 = " + ".join(f"{i + 1} * CAST({e} AS DOUBLE)" for i, e in enumerate(slots))
    return (f"round(CASE WHEN lang = 'en' THEN {s1} ELSE 0 END, 3) AS s1, "
            f"round(CASE WHEN lang = 'en' THEN {s2} ELSE 0 END, 3) AS s2")


def _norm_sql(raw: str) -> str:
    """First suffix entry (catalogue order), else first prefix entry, else NULL."""
    parts = [f"WHEN ends_with({raw}, {_q(sx)}) THEN {_q('...' + sx)}" for sx in SUFFIXES]
    parts += [f"WHEN starts_with({raw}, {_q(px)}) THEN {_q(px + '...')}" for px in PREFIXES]
    return "(CASE " + " ".join(parts) + " END)"


_W1 = "(" + _case("doc_id % 77", [_q(p) for p in PREFIXES]) + " || ' at offset ' || CAST(n_chars AS VARCHAR))"
_W2 = "('Section ' || source || ' ' || " + _case("doc_id % 10", [_q(x) for x in SUFFIXES]) + ")"
_W3 = "('Unlisted warning for ' || source)"
WARN_SQL = f"""
WITH w AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter([{_norm_sql(_W1)}, {_norm_sql(_W2)}, {_norm_sql(_W3)}],
                                                                lambda x: x IS NOT NULL))) AS ws FROM documents)
"""
CAT = "[" + ", ".join(_q(c) for c in CATALOGUE) + "]"
MD5_32 = "(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)"

ORACLE = {
    "ft_header_vec": f"SELECT doc_id, {_sums_sql(_header_slots())} FROM documents",
    "ft_datadirs_vec": f"SELECT doc_id, {_sums_sql(_datadir_slots())} FROM documents",
    "ft_authenticode_vec": f"SELECT doc_id, {_sums_sql(_auth_slots())} FROM documents",
    "ft_warning_normalize": WARN_SQL + "SELECT doc_id, CASE WHEN lang = 'en' THEN array_to_string(ws, '|') ELSE '' END AS warnings FROM w",
    "ft_warning_vec": WARN_SQL + f"""
, e AS (SELECT doc_id, lang, ws, unnest(CASE WHEN lang = 'en' THEN ws ELSE [] END) AS x FROM w),
ids AS (SELECT doc_id, sum(list_position({CAT}, x)) AS pos FROM e GROUP BY doc_id)
SELECT w.doc_id, round(CASE WHEN lang = 'en' AND len(ws) > 0 THEN 2.0 * len(ws) ELSE 0 END, 3) AS s1,
       round(CASE WHEN lang = 'en' AND len(ws) > 0 THEN coalesce(pos, 0) + 88.0 * len(ws) ELSE 0 END, 3) AS s2
FROM w LEFT JOIN ids USING (doc_id)""",
    "ft_exports_vec": f"""
WITH ws AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 9) AS ex FROM documents),
t AS (SELECT doc_id, unnest(ex) AS tok FROM ws WHERE lang = 'en'),
h AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS u FROM t),
g AS (SELECT doc_id, {MD5_32} AS hh FROM h),
b AS (SELECT doc_id, CASE WHEN hh = -2147483648 THEN (2147483647 - 127) % 128 ELSE abs(hh) % 128 END AS idx,
             CASE WHEN hh >= 0 THEN 1.0 ELSE -1.0 END AS sg FROM g),
agg AS (SELECT doc_id, sum(sg) AS s, sum((idx + 2) * sg) AS ws FROM b GROUP BY doc_id)
SELECT ws.doc_id, round(CASE WHEN lang = 'en' AND len(ex) > 0 THEN 128 + s ELSE 0 END, 3) AS s1,
       round(CASE WHEN lang = 'en' AND len(ex) > 0 THEN 128 + agg.ws ELSE 0 END, 3) AS s2
FROM ws LEFT JOIN agg USING (doc_id)""",
    "ft_section_stats": """
WITH s AS (SELECT doc_id, n_chars AS n, string_split_regex(text, '[.]') AS ss FROM documents WHERE lang = 'en'),
l AS (SELECT doc_id, n, list_transform(ss, lambda x: length(x)) AS ls, list_transform(ss, lambda x: lower(trim(x))) AS nm FROM s)
SELECT doc_id, CAST(len(ls) AS DOUBLE) AS n_sections,
  CAST(len(list_filter(ls, lambda x: x = 0)) AS DOUBLE) AS n_zero_size,
  CAST(len(list_filter(nm, lambda x: x = '')) AS DOUBLE) AS n_empty_name,
  CAST(len(list_filter(ls, lambda x: x % 3 = 0)) AS DOUBLE) AS n_rx,
  CAST(len(list_filter(ls, lambda x: x % 3 = 1)) AS DOUBLE) AS n_w,
  round(greatest(list_max(list_transform(ls, lambda x: (x % 80) / 10.0)), 1.5, 0.0), 4) AS max_entropy,
  round(least(list_min(list_transform(ls, lambda x: (x % 80) / 10.0)), 1.5, 0.0), 4) AS min_entropy,
  round(greatest(list_max(list_transform(ls, lambda x: x / n)), (n % 100) / n, 0.0), 4) AS max_size_ratio,
  round(least(list_min(list_transform(ls, lambda x: x / n)), (n % 100) / n, 0.0), 4) AS min_size_ratio,
  round(greatest(list_max(list_transform(ls, lambda x: x / (x + 10))), 0.0), 4) AS max_vsize_ratio,
  round(least(list_min(list_transform(ls, lambda x: x / (x + 10))), 0.0), 4) AS min_vsize_ratio
FROM l""",
    "ft_zero_block": """
WITH ws AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 9) AS ex FROM documents)
SELECT count_if(lang <> 'en') AS zero_header, count_if(lang <> 'en') AS zero_datadirectories,
       count_if(lang <> 'en') AS zero_authenticode, count_if(lang <> 'en') AS zero_pefilewarnings,
       count_if(lang <> 'en' OR len(ex) = 0) AS zero_exports FROM ws""",
}
_sub = _header_slots() + _datadir_slots() + _auth_slots()
ORACLE["ft_block_subset"] = f"SELECT doc_id, 116 AS dim, {_sums_sql(_sub)} FROM documents"


# ---- hashed blocks in md5 mode -------------------------------------------------------------------

def q_ft_imports_vec(spark, sf):
    """Imports block (Murmur3 Arrow hashing, 1282 wide) as checksums."""
    v = pe.assemble(_recs(spark, sf), "raw", ["imports"])
    return v.select("doc_id", F.size("features").alias("dim"), *_sums(F.col("features")))


def q_ft_rich_vec(spark, sf):
    return _vec_sums(_recs(spark, sf), pe.richheader_vec(F.col("raw.richheader"), mode="md5"))


def q_ft_section_hash(spark, sf):
    """Section block incl. the four 50-wide and the 10-wide hashed lists (Murmur3)."""
    v = pe.assemble(_recs(spark, sf), "raw", ["section"])
    return v.select("doc_id", F.size("features").alias("dim"), *_sums(F.col("features")))


QUERIES.update({"ft_imports_vec": q_ft_imports_vec, "ft_rich_vec": q_ft_rich_vec, "ft_section_hash": q_ft_section_hash})

_HB = """CASE WHEN hh = -2147483648 THEN (2147483647 - ({n} - 1)) % {n} ELSE abs(hh) % {n} END"""

ORACLE["ft_rich_vec"] = f"""
WITH ws AS (SELECT doc_id, lang, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 3),
                                                 lambda x: length(x)) AS v FROM documents),
p AS (SELECT doc_id, v, unnest(range(0, greatest(len(v) - 1, 0), 2)) AS i FROM ws WHERE lang = 'en'),
h AS (SELECT doc_id, CAST(v[i + 2] AS DOUBLE) AS val, ('0x' || substr(md5(CAST(v[i + 1] AS VARCHAR)), 1, 8))::BIGINT AS u FROM p),
b AS (SELECT doc_id, val, {_HB.format(n=32)} AS idx, CASE WHEN hh >= 0 THEN 1.0 ELSE -1.0 END AS sg
      FROM (SELECT doc_id, val, {MD5_32} AS hh FROM h)),
a AS (SELECT doc_id, sum(sg * val) AS s, sum((idx + 2) * sg * val) AS w FROM b GROUP BY doc_id)
SELECT ws.doc_id,
  round(CASE WHEN lang = 'en' AND len(v) > 0 THEN floor(len(v) / 2) + coalesce(s, 0) ELSE 0 END, 3) AS s1,
  round(CASE WHEN lang = 'en' AND len(v) > 0 THEN floor(len(v) / 2) + coalesce(w, 0) ELSE 0 END, 3) AS s2
FROM ws LEFT JOIN a USING (doc_id)"""
