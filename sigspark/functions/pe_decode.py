"""Columnar decoding of PE headers and section tables from file bytes.

Every number is read by a column expression from a table of (name, offset, width):
the bytes as hexadecimal text, turned around for little-endian order and converted. Only the two
tables at fixed places are read (headers behind ``e_lfanew``, section records behind
the optional header); no pointers into the rest of the file are followed. The entropies of
byte ranges come from one Arrow UDF over the file and all its ranges.

``decode_header`` gives the raw record's ``header`` struct and ``decode_sections`` its
``section`` struct, so both feed the vectorisers as the JSONL records do. A file that cannot be
read has a NULL struct and an error text; a section table that the file cuts off gives the records
that are whole, and an error text.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pe

# Fixed values of the file format: offset and width of every field.
DOS_FIELDS = [("e_magic", 0, 2), ("e_cblp", 2, 2), ("e_cp", 4, 2), ("e_crlc", 6, 2), ("e_cparhdr", 8, 2), ("e_minalloc", 10, 2),
              ("e_maxalloc", 12, 2), ("e_ss", 14, 2), ("e_sp", 16, 2), ("e_csum", 18, 2), ("e_ip", 20, 2), ("e_cs", 22, 2),
              ("e_lfarlc", 24, 2), ("e_ovno", 26, 2), ("e_oemid", 36, 2), ("e_oeminfo", 38, 2), ("e_lfanew", 60, 4)]
COFF_FIELDS = [("machine", 4, 2), ("number_of_sections", 6, 2), ("timestamp", 8, 4), ("pointer_to_symbol_table", 12, 4),
               ("number_of_symbols", 16, 4), ("sizeof_optional_header", 20, 2), ("characteristics", 22, 2)]
OPTIONAL_FIELDS = [("magic", 0, 2), ("major_linker_version", 2, 1), ("minor_linker_version", 3, 1), ("sizeof_code", 4, 4),
                   ("sizeof_initialized_data", 8, 4), ("sizeof_uninitialized_data", 12, 4), ("address_of_entrypoint", 16, 4),
                   ("base_of_code", 20, 4), ("section_alignment", 32, 4), ("file_alignment", 36, 4),
                   ("major_operating_system_version", 40, 2), ("minor_operating_system_version", 42, 2), ("major_image_version", 44, 2),
                   ("minor_image_version", 46, 2), ("major_subsystem_version", 48, 2), ("minor_subsystem_version", 50, 2),
                   ("sizeof_image", 56, 4), ("sizeof_headers", 60, 4), ("checksum", 64, 4), ("subsystem", 68, 2), ("dll_characteristics", 70, 2)]
# The fields whose place depends on the kind of image: (32 bit, 64 bit).
WIDE_FIELDS = {"image_base": ((28, 4), (24, 8)), "sizeof_stack_reserve": ((72, 4), (72, 8)), "sizeof_stack_commit": ((76, 4), (80, 8)),
               "sizeof_heap_reserve": ((80, 4), (88, 8)), "sizeof_heap_commit": ((84, 4), (96, 8)), "number_of_rvas_and_sizes": ((92, 4), (108, 4))}
SECTION_FIELDS = [("vsize", 8, 4), ("address", 12, 4), ("size", 16, 4), ("pointer", 20, 4), ("characteristics", 36, 4)]
PE32_PLUS = 0x20B
# Codes of pe.MACHINE_TYPES and pe.SUBSYSTEM_TYPES, in the same order.
MACHINE_CODES = [0x0, 0x14C, 0x162, 0x166, 0x168, 0x169, 0x184, 0x1A2, 0x1A3, 0x1A4, 0x1A6, 0x1A8, 0x1C0, 0x1C2, 0x1C4, 0x1D3, 0x1F0, 0x1F1,
                 0x200, 0x266, 0x284, 0x284, 0x366, 0x466, 0x520, 0xCEF, 0xEBC, 0x5032, 0x5064, 0x5128, 0x6232, 0x6264, 0x8664, 0x9041, 0xAA64, 0xC0EE]
SUBSYSTEM_CODES = [0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 16]
# Bits of section characteristics.
SECTION_FLAGS = [("TYPE_DSECT", 0x1), ("TYPE_NOLOAD", 0x2), ("TYPE_GROUP", 0x4), ("TYPE_NO_PAD", 0x8), ("TYPE_COPY", 0x10), ("CNT_CODE", 0x20),
                 ("CNT_INITIALIZED_DATA", 0x40), ("CNT_UNINITIALIZED_DATA", 0x80), ("LNK_OTHER", 0x100), ("LNK_INFO", 0x200), ("LNK_OVER", 0x400),
                 ("LNK_REMOVE", 0x800), ("LNK_COMDAT", 0x1000), ("MEM_PROTECTED", 0x4000), ("NO_DEFER_SPEC_EXC", 0x4000), ("GPREL", 0x8000),
                 ("MEM_FARDATA", 0x8000), ("MEM_SYSHEAP", 0x10000), ("MEM_PURGEABLE", 0x20000), ("MEM_16BIT", 0x20000), ("MEM_LOCKED", 0x40000),
                 ("MEM_PRELOAD", 0x80000), ("LNK_NRELOC_OVFL", 0x1000000), ("MEM_DISCARDABLE", 0x2000000), ("MEM_NOT_CACHED", 0x4000000),
                 ("MEM_NOT_PAGED", 0x8000000), ("MEM_SHARED", 0x10000000), ("MEM_EXECUTE", 0x20000000), ("MEM_READ", 0x40000000),
                 ("MEM_WRITE", 0x80000000)]
EXECUTABLE = 0x20000000
RECORD = 40


def little_endian(content: Column, offset: Column, width: int) -> Column:
    """Unsigned number of ``width`` bytes at an offset; NULL beyond the end. 8 bytes give DECIMAL(20, 0), fewer BIGINT."""
    text = F.hex(F.substring(content, offset + 1, F.lit(width)))
    turned = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(width))])
    value = F.conv(turned, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")
    return F.when((offset >= 0) & (offset + width <= F.length(content)), value)


def name_of_code(code: Column, names: list[str], codes: list[int], unknown: str) -> Column:
    table = F.create_map(*[x for c, n in dict(zip(codes, names)).items() for x in (F.lit(c).cast("bigint"), F.lit(n))])
    return F.coalesce(F.try_element_at(table, code), F.lit(unknown))


def flag_names(bits: Column, flags: list[tuple[str, int]]) -> Column:
    """Names of the flags that are set, in the order of the table."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b).cast("bigint")) != 0, F.lit(n)) for n, b in flags]))


def decode_header(df: DataFrame, content: str = "content", out: str = "header", error: str = "header_error") -> DataFrame:
    """``ft_header_decode``: adds ``out`` (the raw record's header struct) and ``error`` (NULL where all was read)."""
    c, at = F.col(content), F.col("__at")
    d = df.withColumn("__at", little_endian(c, F.lit(60), 4))
    opt = at + 24
    d = d.withColumn("__wide", little_endian(c, opt, 2) == PE32_PLUS)
    wide = F.coalesce(F.col("__wide"), F.lit(False))
    end = opt + F.when(wide, F.lit(112)).otherwise(F.lit(96))
    fault = (F.when(c.isNull() | (F.length(c) < 64), F.lit("shorter than a DOS header"))
             .when(F.substring(c, 1, 2) != F.lit(b"MZ"), F.lit("no DOS signature"))
             .when(at + 24 > F.length(c), F.lit("header lies beyond the end"))
             .when(F.substring(c, (at + 1).cast("int"), F.lit(4)) != F.lit(b"PE\0\0"), F.lit("no PE signature"))
             .when(end > F.length(c), F.lit("header is cut off")))
    d = d.withColumn(error, fault)
    ints = at.cast("int")
    coff = {n: little_endian(c, ints + o, w) for n, o, w in COFF_FIELDS}
    optional = {n: little_endian(c, ints + 24 + o, w) for n, o, w in OPTIONAL_FIELDS}
    most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    for n, ((o32, w32), (o64, w64)) in WIDE_FIELDS.items():
        both = F.when(wide, little_endian(c, ints + 24 + o64, w64).cast("decimal(20,0)")).otherwise(
            little_endian(c, ints + 24 + o32, w32).cast("decimal(20,0)"))
        optional[n] = both if n == "image_base" else F.least(both, most).cast("bigint")
    optional["subsystem"] = name_of_code(optional["subsystem"], pe.SUBSYSTEM_TYPES, SUBSYSTEM_CODES, "IMAGE_SUBSYSTEM_UNKNOWN")
    optional["dll_characteristics"] = flag_names(optional["dll_characteristics"], [(n, 1 << (5 + i)) for i, n in enumerate(pe.DLL_CHARACTERISTICS)])
    optional["base_of_data"] = F.lit(0).cast("bigint")            # the records never fill it
    coff["machine"] = name_of_code(coff["machine"], pe.MACHINE_TYPES, MACHINE_CODES, "IMAGE_FILE_MACHINE_UNKNOWN")
    coff["characteristics"] = flag_names(coff["characteristics"], [(n, 1 << i) for i, n in enumerate(pe.IMAGE_CHARACTERISTICS)])
    dos = {n: little_endian(c, F.lit(o), w) for n, o, w in DOS_FIELDS}
    made = F.struct(*[F.struct(*[fields[f.name].alias(f.name) for f in part.dataType.fields]).alias(part.name)
                      for part, fields in zip(pe.HEADER_SCHEMA.fields, (coff, optional, dos))])
    return d.withColumn(out, F.when(F.col(error).isNull(), made)).drop("__at", "__wide")


def range_entropies(content: Column, ranges: Column) -> Column:
    """Entropy in bits of each (start, end) byte range of a file; 0 for an empty one."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(files: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for data, spans in zip(files, wanted):
            if data is None or spans is None:
                out.append(None)
                continue
            buf, found = np.frombuffer(data, np.uint8), []
            for s in spans:
                count = np.bincount(buf[max(0, s["start"]): max(0, s["end"])], minlength=256)
                count = count[count > 0]
                share = count / max(1, count.sum())
                found.append(float(-(share * np.log2(share)).sum()) + 0.0)
            out.append(found)
        return pd.Series(out)
    return run(content, ranges)


def decode_sections(df: DataFrame, content: str = "content", out: str = "section", error: str = "section_error") -> DataFrame:
    """``ft_section_decode``: adds ``out`` (entry section, section rows, overlay) and ``error``.

    The entry section is the last one that contains the entry point, else the first executable one with a name. The overlay
    is what lies behind the last byte that the headers or a section inside the file claim.
    """
    d = decode_header(df, content, "__header", "__header_error")
    c, n = F.col(content), F.length(content)
    at = little_endian(c, F.lit(60), 4)
    d = d.withColumn("__opt", F.when(F.col("__header_error").isNull(), (at + 24).cast("int")))
    opt = F.col("__opt")
    d = (d.withColumn("__table", opt + F.col("__header.coff.sizeof_optional_header").cast("int"))
          .withColumn("__count", F.col("__header.coff.number_of_sections").cast("int"))
          .withColumn("__falign", little_endian(c, opt + 36, 4)).withColumn("__salign", little_endian(c, opt + 32, 4)))
    whole = F.least(F.col("__count"), F.greatest(F.floor((n - F.col("__table")) / RECORD).cast("int"), F.lit(0)))
    d = d.withColumn("__whole", F.when(F.col("__header_error").isNull(), whole))
    # the table's bytes alone: a lambda over them does not touch the rest of the file
    d = d.withColumn("__records", F.substring(c, F.col("__table") + 1, F.col("__whole") * RECORD))
    records = F.col("__records")

    def record(i: Column) -> Column:
        start = i * RECORD
        name = F.substring(records, start + 1, F.lit(8))
        printed = F.regexp_replace(F.regexp_replace(F.hex(name), "^(00)+", ""), "^((?:..)*?)(00)+$", "$1")
        text = F.decode(F.unhex(printed), "ISO-8859-1")
        # other bytes than ASCII are no names of sections and are left out, as a lenient decoder does
        return F.struct(F.lower(F.regexp_replace(text, "[^\\x00-\\x7F]", "")).alias("name"),
                        *[little_endian(records, start + o, w).alias(f) for f, o, w in SECTION_FIELDS])

    d = d.withColumn("__rows", F.when(F.col("__whole") > 0, F.transform(F.sequence(F.lit(0), F.col("__whole") - 1), record))
                     .when(F.col("__whole") == 0, F.array().cast("array<struct<name:string,vsize:bigint,address:bigint,size:bigint,pointer:bigint,characteristics:bigint>>")))
    step = F.lit(0x200)
    aligned = lambda p: F.when(F.col("__falign") < step, p).otherwise(p - p % step)
    unit = F.when(F.col("__salign") < 0x1000, F.col("__falign")).otherwise(F.col("__salign"))
    d = d.withColumn("__unit", unit).withColumn("__entry", F.col("__header.optional.address_of_entrypoint"))
    base = lambda s: s["address"] - F.when(F.col("__unit") > 0, s["address"] % F.col("__unit")).otherwise(F.lit(0))
    held = lambda s: F.when(n - aligned(s["pointer"]) < s["size"], s["vsize"]).otherwise(F.greatest(s["size"], s["vsize"]))
    inside = F.filter("__rows", lambda s: (base(s) <= F.col("__entry")) & (F.col("__entry") < base(s) + held(s)))
    runs = F.filter("__rows", lambda s: (s["characteristics"].bitwiseAND(F.lit(EXECUTABLE).cast("bigint")) != 0) & (s["name"] != ""))
    nonempty = lambda x: F.when(x != "", x)
    entry = F.coalesce(nonempty(F.try_element_at(F.transform(F.filter(inside, lambda s: s["name"] != ""), lambda s: s["name"]), F.lit(-1))),
                       F.get(F.transform(runs, lambda s: s["name"]), F.lit(0)), F.lit(""))
    headers = opt + F.col("__header.coff.sizeof_optional_header")
    claimed = F.transform(F.filter("__rows", lambda s: s["pointer"] + s["size"] <= n), lambda s: s["pointer"] + s["size"])
    claims = F.concat(F.array(F.lit(0).cast("bigint"), F.when(headers <= n, headers.cast("bigint")).otherwise(F.lit(0).cast("bigint"))), claimed)
    d = d.withColumn("__entry_name", entry).withColumn("__over", F.array_max(claims))
    spans = F.concat(F.transform("__rows", lambda s: F.struct(F.least(aligned(s["pointer"]), n.cast("bigint")).alias("start"),
                                                              F.least(aligned(s["pointer"]) + s["size"], n.cast("bigint")).alias("end"))),
                     F.array(F.struct(F.col("__over").alias("start"), n.cast("bigint").alias("end"))))
    d = d.withColumn("__spans", spans).withColumn("__entropy", range_entropies(c, F.col("__spans")))
    sections = F.zip_with("__rows", F.slice("__entropy", 1, F.greatest(F.size("__rows"), F.lit(0))), lambda s, e: F.struct(
        s["name"].alias("name"), s["size"].alias("size"), e.alias("entropy"), s["vsize"].alias("vsize"),
        (s["size"] / n).alias("size_ratio"), (s["size"] / F.greatest(s["vsize"], F.lit(1))).alias("vsize_ratio"),
        flag_names(s["characteristics"], SECTION_FLAGS).alias("props")))
    over = (n - F.col("__over")).cast("bigint")
    overlay = F.struct(over.alias("size"), (over / n).alias("size_ratio"),
                       F.when(over > 0, F.try_element_at("__entropy", F.lit(-1))).otherwise(F.lit(0.0)).alias("entropy"))
    made = F.struct(F.col("__entry_name").alias("entry"), sections.alias("sections"), overlay.alias("overlay"))
    fault = F.coalesce(F.col("__header_error"), F.when(F.col("__whole") < F.col("__count"), F.concat(
        F.lit("only "), F.col("__whole").cast("string"), F.lit(" of "), F.col("__count").cast("string"), F.lit(" section records are whole"))))
    d = d.withColumn(error, fault).withColumn(out, F.when(F.col("__header_error").isNull(), made))
    return d.select(*df.columns, out, error)
