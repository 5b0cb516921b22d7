"""Registered queries that decode executable images from bytes.

The images are made by SQL from ``documents``: a header whose fields follow from the id, the text as the data of one
section, a few bytes behind it. Some are cut off, some lack the signature. The oracle does not
parse anything: it states the fields that went in.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pe_decode as pd_
from ..sources.tables import table


def _le(value: str, width: int) -> str:
    """SQL for the little-endian hexadecimal text of a number."""
    part = lambda i: f"format_string('%02X', CAST(({value}) AS BIGINT) div {256 ** i} % 256)"
    return "concat(" + ", ".join(part(i) for i in range(width)) + ")"


def _bytes(*parts) -> str:
    """SQL for hexadecimal text: literals as they are, (value, width) as little-endian numbers."""
    return "concat(" + ", ".join(f"'{p}'" if isinstance(p, str) else _le(str(p[0]), p[1]) for p in parts) + ")"


DOS = _bytes("4D5A", ("doc_id % 65536", 2), "00" * 56, ("64 + 8 * (doc_id % 3)", 4))
COFF = _bytes("50450000", ("CASE doc_id % 3 WHEN 0 THEN 332 WHEN 1 THEN 34404 ELSE 4660 END", 2), (2, 2), ("1600000000 + doc_id", 4), (0, 4),
              ("doc_id % 7", 4), ("CASE WHEN doc_id % 2 = 0 THEN 96 ELSE 112 END", 2), ("doc_id * 3 % 65536", 2))
HEAD = [(14, 1), (2, 1), ("n", 4), ("doc_id", 4), (0, 4), ("4096 + 10 * (doc_id % 4)", 4), (4096, 4)]
MIDDLE = [(4096, 4), (512, 4), (6, 2), (0, 2), (1, 2), (2, 2), (6, 2), (1, 2), (0, 4), ("n + 8192", 4), (512, 4), ("doc_id * 5", 4),
          ("CASE WHEN doc_id % 4 = 3 THEN 99 ELSE 2 + doc_id % 2 END", 2), ("doc_id * 37 % 65536", 2)]
PE32 = _bytes("0B01", *HEAD, (0, 4), (4194304, 4), *MIDDLE, (1048576, 4), (4096, 4), (1048576, 4), ("doc_id", 4), (0, 4), (16, 4))
PE32_PLUS = _bytes("0B02", *HEAD, (5368709120, 8), *MIDDLE, (1048576, 8), (4096, 8), (1048576, 8), ("doc_id", 8), (0, 4), (16, 4))
SECTIONS = ("concat(" + _bytes("2E74657874000000", ("2 * n", 4), (4096, 4), ("n", 4), (512, 4), "0" * 24, (0x60000020, 4))
            + ", rpad(hex(encode(concat('S', lang), 'UTF-8')), 16, '0'), " + _bytes((0, 4), (1073741824, 4), (0, 4), (0, 4), "0" * 24, (0xC0000040, 4)) + ")")
IMAGE = f"""
SELECT doc_id, unhex(CASE doc_id % 10 WHEN 9 THEN substring(h, 1, 200) WHEN 8 THEN concat('5A', substring(h, 3)) ELSE h END) AS content
FROM (SELECT doc_id, concat(rpad(concat({DOS}, repeat('00', CAST(8 * (doc_id % 3) AS INT)), {COFF}, CASE WHEN doc_id % 2 = 0 THEN {PE32} ELSE {PE32_PLUS} END,
                                        {SECTIONS}), 1024, '0'), hex(bytes), repeat('41', CAST(doc_id % 9 AS INT))) AS h
      FROM (SELECT doc_id, coalesce(lang, 'xx') AS lang, encode(coalesce(text, ''), 'UTF-8') AS bytes,
                   octet_length(coalesce(text, '')) AS n FROM images_of) a) b
"""


def images(spark, sf):
    """(doc_id, content): one image for each document."""
    table(spark, sf, "documents").createOrReplaceTempView("images_of")
    return spark.sql(IMAGE)


def q_ft_header_decode(spark, sf):
    d = pd_.decode_header(images(spark, sf))
    h = F.col("header")
    return d.select("doc_id", F.col("header_error").alias("error"), h["dos"]["e_cblp"].alias("e_cblp"), h["coff"]["machine"].alias("machine"),
                    h["coff"]["timestamp"].alias("timestamp"), F.size(h["coff"]["characteristics"]).alias("n_flags"),
                    h["optional"]["magic"].alias("magic"), h["optional"]["sizeof_code"].alias("sizeof_code"),
                    h["optional"]["address_of_entrypoint"].alias("entry_point"), h["optional"]["image_base"].cast("bigint").alias("image_base"),
                    h["optional"]["checksum"].alias("checksum"), h["optional"]["subsystem"].alias("subsystem"),
                    F.size(h["optional"]["dll_characteristics"]).alias("n_dll_flags"),
                    h["optional"]["sizeof_heap_commit"].alias("heap_commit"), h["optional"]["number_of_rvas_and_sizes"].alias("n_rvas"))


def q_ft_section_decode(spark, sf):
    d = pd_.decode_sections(images(spark, sf))
    s = F.col("section")
    one, two = F.get(s["sections"], F.lit(0)), F.get(s["sections"], F.lit(1))
    return d.select("doc_id", F.col("section_error").alias("error"), s["entry"].alias("entry"), F.size(s["sections"]).alias("n_sections"),
                    two["name"].alias("second_name"), one["size"].alias("first_size"), F.round(one["entropy"], 6).alias("first_entropy"),
                    F.round(one["size_ratio"], 6).alias("size_ratio"), F.round(one["vsize_ratio"], 6).alias("vsize_ratio"),
                    F.array_join(one["props"], ",").alias("first_props"), s["overlay"]["size"].alias("overlay_size"),
                    F.round(s["overlay"]["size_ratio"], 6).alias("overlay_ratio"))


QUERIES = {"ft_header_decode": q_ft_header_decode, "ft_section_decode": q_ft_section_decode}

FILES = """
WITH f AS (SELECT doc_id AS i, coalesce(lang, 'xx') AS lang, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
e AS (SELECT *, CASE WHEN i % 10 = 8 THEN 'no DOS signature' WHEN i % 10 = 9 AND i % 3 = 2 THEN 'header lies beyond the end'
                     WHEN i % 10 = 9 THEN 'header is cut off' END AS error FROM f)
"""

ORACLE = {
    "ft_header_decode": FILES + """
SELECT i AS doc_id, error, CASE WHEN error IS NULL THEN i % 65536 END AS e_cblp,
       CASE WHEN error IS NULL THEN CASE i % 3 WHEN 0 THEN 'IMAGE_FILE_MACHINE_I386' WHEN 1 THEN 'IMAGE_FILE_MACHINE_AMD64'
                                               ELSE 'IMAGE_FILE_MACHINE_UNKNOWN' END END AS machine,
       CASE WHEN error IS NULL THEN 1600000000 + i END AS timestamp,
       CASE WHEN error IS NULL THEN bit_count(CAST(i * 3 % 65536 AS INTEGER)) END AS n_flags,
       CASE WHEN error IS NULL THEN CASE WHEN i % 2 = 0 THEN 267 ELSE 523 END END AS magic,
       CASE WHEN error IS NULL THEN n END AS sizeof_code, CASE WHEN error IS NULL THEN 4096 + 10 * (i % 4) END AS entry_point,
       CASE WHEN error IS NULL THEN CASE WHEN i % 2 = 0 THEN 4194304 ELSE 5368709120 END END AS image_base,
       CASE WHEN error IS NULL THEN i * 5 END AS checksum,
       CASE WHEN error IS NULL THEN CASE WHEN i % 4 = 3 THEN 'IMAGE_SUBSYSTEM_UNKNOWN' WHEN i % 2 = 0 THEN 'IMAGE_SUBSYSTEM_WINDOWS_GUI'
                                         ELSE 'IMAGE_SUBSYSTEM_WINDOWS_CUI' END END AS subsystem,
       CASE WHEN error IS NULL THEN bit_count(CAST((i * 37 % 65536) & 65504 AS INTEGER)) END AS n_dll_flags,
       CASE WHEN error IS NULL THEN i END AS heap_commit, CASE WHEN error IS NULL THEN 16 END AS n_rvas
FROM e""",
    "ft_section_decode": FILES + """,
b AS (SELECT i, n, substr(hex(bytes), 2 * k + 1, 2) AS byte FROM f, range(n) t(k)),
h AS (SELECT i, n, byte, count(*) AS c FROM b GROUP BY ALL),
s AS (SELECT i, -sum(c / n * log2(c / n)) AS entropy FROM h GROUP BY i)
SELECT e.i AS doc_id, error, CASE WHEN error IS NULL THEN '.text' END AS entry, CASE WHEN error IS NULL THEN 2 END AS n_sections,
       CASE WHEN error IS NULL THEN 's' || lang END AS second_name, CASE WHEN error IS NULL THEN n END AS first_size,
       CASE WHEN error IS NULL THEN round(coalesce(entropy, 0), 6) END AS first_entropy,
       CASE WHEN error IS NULL THEN round(n / (512 + n + i % 9), 6) END AS size_ratio,
       CASE WHEN error IS NULL THEN round(n / greatest(2 * n, 1), 6) END AS vsize_ratio,
       CASE WHEN error IS NULL THEN 'CNT_CODE,MEM_EXECUTE,MEM_READ' END AS first_props,
       CASE WHEN error IS NULL THEN i % 9 END AS overlay_size, CASE WHEN error IS NULL THEN round((i % 9) / (512 + n + i % 9), 6) END AS overlay_ratio
FROM e LEFT JOIN s USING (i)""",
}
