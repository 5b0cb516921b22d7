"""PE raw-record stand-in derived from ``documents``.

English documents play PE files, the others non-PE files (empty PE blocks).
Every block value is a simple rule over the document's columns and its whole
text (sentences -> sections, words -> imports / exports / rich header), so
the hashed blocks grow with the text. The record is serialised with
``to_json`` and parsed back with ``RAW_SCHEMA``, i.e. through the same path a
real JSONL corpus takes. ``sql_*`` helpers give the same rules as DuckDB SQL
for the oracles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pe
from ..functions.warnings import PREFIXES, SUFFIXES
from .tables import table

MACHINE_BY_MOD4 = ["IMAGE_FILE_MACHINE_I386", "IMAGE_FILE_MACHINE_AMD64", "IMAGE_FILE_MACHINE_ARM64", "MACHINE_NOT_LISTED"]
SUBSYSTEM_BY_MOD3 = ["IMAGE_SUBSYSTEM_WINDOWS_GUI", "IMAGE_SUBSYSTEM_WINDOWS_CUI", "SUBSYSTEM_NOT_LISTED"]
CHARS_BY_MOD3 = [["EXECUTABLE_IMAGE", "32BIT_MACHINE"], ["EXECUTABLE_IMAGE", "DLL"], ["RELOCS_STRIPPED"]]


def _pick(idx: Column, values: list) -> Column:
    e = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        e = F.when(idx == i, F.lit(values[i])).otherwise(e)
    return e


def _str_array(xs):
    return F.array(*[F.lit(x) for x in xs])


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= 3)


def sentences(text: Column) -> Column:
    return F.split(text, "[.]")


def ratio(x: Column, n: Column) -> Column:
    """x / n as the oracles divide: by 0 gives NaN or infinity (Spark's ``/`` would end the job there)."""
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x == 0, F.lit(float("nan")))
    return F.when(n == 0, by_zero).otherwise(x / n)


#: Parts of the alphabet: the letters from the first, below the second.
ALPHABET = [("a", "c"), ("c", "f"), ("f", "l"), ("l", "p"), ("p", "t"), ("t", "{")]
#: Columns of the split texts, made once: an expression would be split again wherever it is read.
WORDS, SENTENCES, LETTERS = "__words", "__sentences", "__letters"


def with_parts(d: DataFrame) -> DataFrame:
    """The documents with their words, the words' first letters, and sentences as columns."""
    split = d.withColumn(WORDS, words(F.col("text"))).withColumn(SENTENCES, sentences(F.col("text")))
    return split.withColumn(LETTERS, F.sort_array(F.array_distinct(F.transform(WORDS, lambda w: F.substring(w, 1, 1)))))


def raw_struct() -> Column:
    """The record as a struct over the columns of ``with_parts``."""
    doc, n, text = F.col("doc_id"), F.col("n_chars"), F.col("text")
    coff = F.struct(n.alias("timestamp"), _pick(doc % 4, MACHINE_BY_MOD4).alias("machine"),
                    (doc % 7 + 1).alias("number_of_sections"), F.lit(0).alias("number_of_symbols"),
                    F.lit(224).alias("sizeof_optional_header"), F.lit(0).alias("pointer_to_symbol_table"),
                    F.when(doc % 3 == 0, _str_array(CHARS_BY_MOD3[0])).when(doc % 3 == 1, _str_array(CHARS_BY_MOD3[1]))
                     .otherwise(_str_array(CHARS_BY_MOD3[2])).alias("characteristics"))
    opt = F.struct(F.lit(267).alias("magic"), _pick(doc % 3, SUBSYSTEM_BY_MOD3).alias("subsystem"),
                   *[(F.lit(4194304) if f == "image_base" else (n + j) % 97).alias(f)
                     for j, f in enumerate(pe.OPTIONAL_SCALARS)],
                   F.lit(0).alias("base_of_data"),
                   F.when(doc % 2 == 0, _str_array(["NX_COMPAT", "DYNAMIC_BASE"])).otherwise(F.array().cast("array<string>"))
                    .alias("dll_characteristics"))
    dos = F.struct(*[(F.lit(23117) if m == "e_magic" else F.lit(128) if m == "e_lfanew" else (doc + j) % 13).alias(m)
                     for j, m in enumerate(pe.DOS_MEMBERS)])
    sents = F.col(SENTENCES)
    secs = F.transform(sents, lambda s: F.struct(
        F.lower(F.trim(s)).alias("name"), F.length(s).alias("size"), ((F.length(s) % 80) / 10.0).alias("entropy"),
        (F.length(s) + 10).alias("vsize"), ratio(F.length(s), n).alias("size_ratio"),
        (F.length(s) / (F.length(s) + 10)).alias("vsize_ratio"),
        F.when(F.length(s) % 3 == 0, _str_array(["MEM_READ", "MEM_EXECUTE"]))
         .when(F.length(s) % 3 == 1, _str_array(["MEM_WRITE"])).otherwise(F.array().cast("array<string>")).alias("props")))
    section = F.struct(F.lower(F.trim(F.try_element_at(sents, F.lit(1)))).alias("entry"), secs.alias("sections"),
                       F.struct((n % 100).alias("size"), ratio(n % 100, n).alias("size_ratio"), F.lit(1.5).alias("entropy")).alias("overlay"))
    ws = F.col(WORDS)
    letters = F.col(LETTERS)
    # words are dealt to parts of the alphabet first, so that a letter looks through those of its part only
    parts = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ALPHABET]), lambda p: F.struct(
        F.filter(letters, lambda l: (l >= p["a"]) & (l < p["b"])).alias("letters"),
        F.filter(ws, lambda w: (w >= p["a"]) & (w < p["b"])).alias("words")))
    imports = F.map_from_entries(F.flatten(F.transform(parts, lambda p: F.transform(p["letters"], lambda l: F.struct(
        F.when(l < "m", F.concat(F.upper(l), F.lit(".DLL"))).otherwise(F.concat(l, F.lit(".dll"))).alias("k"),
        F.filter(p["words"], lambda w: w.startswith(l)).alias("v"))))))
    exports = F.filter(ws, lambda w: F.length(w) >= 9)
    dd = F.concat(F.array(F.struct((doc % 2).alias("has_relocs"), F.lit(0).alias("has_dynamic_relocs"),
                                   F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("size"),
                                   F.lit(None).cast("bigint").alias("virtual_address"))),
                  F.array(*[F.struct(F.lit(None).cast("int").alias("has_relocs"), F.lit(None).cast("int").alias("has_dynamic_relocs"),
                                     F.lit(nm).alias("name"), (n % (j + 7)).cast("bigint").alias("size"),
                                     F.lit(j * 4096).cast("bigint").alias("virtual_address"))
                            for j, nm in enumerate(pe.DATA_DIRECTORY_NAMES)]))
    rich = F.transform(ws, lambda w: F.length(w).cast("bigint"))
    auth = F.struct((doc % 3).alias("num_certs"), (doc % 2).alias("self_signed"), F.lit(0).alias("empty_program_name"),
                    ((doc + 1) % 2).alias("no_countersigner"), F.lit(0).alias("parse_error"), (doc % 4).alias("chain_max_depth"),
                    n.alias("latest_signing_time"), (n - 100).alias("signing_time_diff"))
    raw_w = F.array(F.concat(_pick(doc % len(PREFIXES), PREFIXES), F.lit(" at offset "), n.cast("string")),
                    F.concat(F.lit("Section "), F.col("source"), F.lit(" "), _pick(doc % len(SUFFIXES), SUFFIXES)),
                    F.concat(F.lit("Unlisted warning for "), F.col("source")))
    from ..functions.warnings import normalize_warnings
    is_pe = F.col("lang") == "en"
    return F.struct(
        F.sha2(text, 256).alias("sha256"),
        F.when(is_pe, F.struct(coff.alias("coff"), opt.alias("optional"), dos.alias("dos"))).alias("header"),
        F.when(is_pe, section).alias("section"),
        F.when(is_pe, imports).otherwise(F.create_map().cast("map<string,array<string>>")).alias("imports"),
        F.when(is_pe, exports).otherwise(F.array().cast("array<string>")).alias("exports"),
        F.when(is_pe, dd).alias("datadirectories"),
        F.when(is_pe, rich).otherwise(F.array().cast("array<bigint>")).alias("richheader"),
        F.when(is_pe, auth).alias("authenticode"),
        F.when(is_pe, normalize_warnings(raw_w)).otherwise(F.array().cast("array<string>")).alias("pefilewarnings"))


def pe_record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, value): one JSON line with the PE blocks per document."""
    d = table(spark, sf, "documents")
    return with_parts(d).select("doc_id", F.to_json(raw_struct()).alias("value"))


def pe_records(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, raw) parsed with RAW_SCHEMA."""
    return pe_record_lines(spark, sf).select("doc_id", pe.parse_raw(F.col("value")).alias("raw"))
