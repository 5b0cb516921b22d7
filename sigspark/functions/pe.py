"""Raw-record schema and the vector form of every feature block.

Each ``*_vec`` function maps the raw block (a struct / array / map column,
as parsed by ``from_json`` with ``RAW_SCHEMA``) to an ARRAY<FLOAT> of the
block's fixed width; an empty or missing block gives zeros. Everything is a
JVM expression except the hashed blocks, which call the Arrow hasher.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as hs
from .bytes import normalize_counts
from .strings import ioc_vector

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): header vocabularies and member
# lists, data directory names, in their original order.
# ---------------------------------------------------------------------------
MACHINE_TYPES = [
    "IMAGE_FILE_MACHINE_UNKNOWN", "IMAGE_FILE_MACHINE_I386", "IMAGE_FILE_MACHINE_R3000",
    "IMAGE_FILE_MACHINE_R4000", "IMAGE_FILE_MACHINE_R10000", "IMAGE_FILE_MACHINE_WCEMIPSV2",
    "IMAGE_FILE_MACHINE_ALPHA", "IMAGE_FILE_MACHINE_SH3", "IMAGE_FILE_MACHINE_SH3DSP",
    "IMAGE_FILE_MACHINE_SH3E", "IMAGE_FILE_MACHINE_SH4", "IMAGE_FILE_MACHINE_SH5",
    "IMAGE_FILE_MACHINE_ARM", "IMAGE_FILE_MACHINE_THUMB", "IMAGE_FILE_MACHINE_ARMNT",
    "IMAGE_FILE_MACHINE_AM33", "IMAGE_FILE_MACHINE_POWERPC", "IMAGE_FILE_MACHINE_POWERPCFP",
    "IMAGE_FILE_MACHINE_IA64", "IMAGE_FILE_MACHINE_MIPS16", "IMAGE_FILE_MACHINE_ALPHA64",
    "IMAGE_FILE_MACHINE_AXP64", "IMAGE_FILE_MACHINE_MIPSFPU", "IMAGE_FILE_MACHINE_MIPSFPU16",
    "IMAGE_FILE_MACHINE_TRICORE", "IMAGE_FILE_MACHINE_CEF", "IMAGE_FILE_MACHINE_EBC",
    "IMAGE_FILE_MACHINE_RISCV32", "IMAGE_FILE_MACHINE_RISCV64", "IMAGE_FILE_MACHINE_RISCV128",
    "IMAGE_FILE_MACHINE_LOONGARCH32", "IMAGE_FILE_MACHINE_LOONGARCH64", "IMAGE_FILE_MACHINE_AMD64",
    "IMAGE_FILE_MACHINE_M32R", "IMAGE_FILE_MACHINE_ARM64", "IMAGE_FILE_MACHINE_CEE",
]
SUBSYSTEM_TYPES = [
    "IMAGE_SUBSYSTEM_UNKNOWN", "IMAGE_SUBSYSTEM_NATIVE", "IMAGE_SUBSYSTEM_WINDOWS_GUI",
    "IMAGE_SUBSYSTEM_WINDOWS_CUI", "IMAGE_SUBSYSTEM_OS2_CUI", "IMAGE_SUBSYSTEM_POSIX_CUI",
    "IMAGE_SUBSYSTEM_NATIVE_WINDOWS", "IMAGE_SUBSYSTEM_WINDOWS_CE_GUI", "IMAGE_SUBSYSTEM_EFI_APPLICATION",
    "IMAGE_SUBSYSTEM_EFI_BOOT_SERVICE_DRIVER", "IMAGE_SUBSYSTEM_EFI_RUNTIME_DRIVER", "IMAGE_SUBSYSTEM_EFI_ROM",
    "IMAGE_SUBSYSTEM_XBOX", "IMAGE_SUBSYSTEM_WINDOWS_BOOT_APPLICATION",
]
IMAGE_CHARACTERISTICS = [
    "RELOCS_STRIPPED", "EXECUTABLE_IMAGE", "LINE_NUMS_STRIPPED", "LOCAL_SYMS_STRIPPED", "AGGRESIVE_WS_TRIM",
    "LARGE_ADDRESS_AWARE", "16BIT_MACHINE", "BYTES_REVERSED_LO", "32BIT_MACHINE", "DEBUG_STRIPPED",
    "REMOVABLE_RUN_FROM_SWAP", "NET_RUN_FROM_SWAP", "SYSTEM", "DLL", "UP_SYSTEM_ONLY", "BYTES_REVERSED_HI",
]
DLL_CHARACTERISTICS = [
    "HIGH_ENTROPY_VA", "DYNAMIC_BASE", "FORCE_INTEGRITY", "NX_COMPAT", "NO_ISOLATION", "NO_SEH", "NO_BIND",
    "APPCONTAINER", "WDM_DRIVER", "GUARD_CF", "TERMINAL_SERVER_AWARE",
]
DOS_MEMBERS = [
    "e_magic", "e_cblp", "e_cp", "e_crlc", "e_cparhdr", "e_minalloc", "e_maxalloc", "e_ss", "e_sp", "e_csum",
    "e_ip", "e_cs", "e_lfarlc", "e_ovno", "e_oemid", "e_oeminfo", "e_lfanew",
]
DATA_DIRECTORY_NAMES = [
    "EXPORT", "IMPORT", "RESOURCE", "EXCEPTION", "SECURITY", "BASERELOC", "DEBUG", "COPYRIGHT", "GLOBALPTR",
    "TLS", "LOAD_CONFIG", "BOUND_IMPORT", "IAT", "DELAY_IMPORT", "COM_DESCRIPTOR", "RESERVED",
]
COFF_SCALARS = ["timestamp", "number_of_sections", "number_of_symbols", "sizeof_optional_header",
                "pointer_to_symbol_table"]
OPTIONAL_SCALARS = [
    "major_image_version", "minor_image_version", "major_linker_version", "minor_linker_version",
    "major_operating_system_version", "minor_operating_system_version", "major_subsystem_version",
    "minor_subsystem_version", "sizeof_code", "sizeof_headers", "sizeof_image", "sizeof_initialized_data",
    "sizeof_uninitialized_data", "sizeof_stack_reserve", "sizeof_stack_commit", "sizeof_heap_reserve",
    "sizeof_heap_commit", "address_of_entrypoint", "base_of_code", "image_base", "section_alignment",
    "checksum", "number_of_rvas_and_sizes",
]
AUTHENTICODE_FIELDS = ["num_certs", "self_signed", "empty_program_name", "no_countersigner", "parse_error",
                       "chain_max_depth", "latest_signing_time", "signing_time_diff"]

# Block order and widths of the assembled vector.
BLOCK_DIMS = [("general", 7), ("histogram", 256), ("byteentropy", 256), ("strings", 177), ("header", 74),
              ("section", 224), ("imports", 1282), ("exports", 129), ("datadirectories", 34),
              ("richheader", 33), ("authenticode", 8), ("pefilewarnings", 88)]
VECTOR_DIM = sum(d for _, d in BLOCK_DIMS)

# ---- raw schema --------------------------------------------------------------------------------

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


OPTIONAL_SCHEMA = _st(("magic", _L), ("subsystem", _S),
                      *[(f, T.DecimalType(20, 0) if f == "image_base" else _L) for f in OPTIONAL_SCALARS],
                      ("base_of_data", _L), ("dll_characteristics", T.ArrayType(_S)))
HEADER_SCHEMA = _st(("coff", _st(("timestamp", _L), ("machine", _S), ("number_of_sections", _L),
                                 ("number_of_symbols", _L), ("sizeof_optional_header", _L),
                                 ("pointer_to_symbol_table", _L), ("characteristics", T.ArrayType(_S)))),
                    ("optional", OPTIONAL_SCHEMA),
                    ("dos", _st(*[(m, _L) for m in DOS_MEMBERS])))
SECTION_SCHEMA = _st(("entry", _S),
                     ("sections", T.ArrayType(_st(("name", _S), ("size", _L), ("entropy", _D), ("vsize", _L),
                                                  ("size_ratio", _D), ("vsize_ratio", _D), ("props", T.ArrayType(_S))))),
                     ("overlay", _st(("size", _L), ("size_ratio", _D), ("entropy", _D))))
RAW_SCHEMA = _st(
    ("sha256", _S), ("md5", _S), ("tlsh", _S), ("first_submission_date", _S), ("last_analysis_date", _S),
    ("detection_ratio", _S), ("label", T.IntegerType()), ("file_type", _S), ("week_id", _S), ("family", _S),
    ("behavior", T.ArrayType(_S)), ("file_property", T.ArrayType(_S)), ("packer", T.ArrayType(_S)),
    ("exploit", T.ArrayType(_S)), ("group", T.ArrayType(_S)),
    ("general", _st(("size", _L), ("entropy", _D), ("is_pe", T.IntegerType()), ("start_bytes", T.ArrayType(T.IntegerType())))),
    ("histogram", T.ArrayType(_L)), ("byteentropy", T.ArrayType(_L)),
    ("strings", _st(("numstrings", _L), ("avlength", _D), ("printabledist", T.ArrayType(_D)), ("printables", _L),
                    ("entropy", _D), ("string_counts", T.MapType(_S, _L)))),
    ("header", HEADER_SCHEMA), ("section", SECTION_SCHEMA),
    ("imports", T.MapType(_S, T.ArrayType(_S))), ("exports", T.ArrayType(_S)),
    ("datadirectories", T.ArrayType(_st(("has_relocs", T.IntegerType()), ("has_dynamic_relocs", T.IntegerType()),
                                        ("name", _S), ("size", _L), ("virtual_address", _L)))),
    ("richheader", T.ArrayType(_L)),
    ("authenticode", _st(*[(f, _D) for f in AUTHENTICODE_FIELDS])),
    ("pefilewarnings", T.ArrayType(_S)),
)


def parse_raw(line: Column) -> Column:
    """One JSON line -> RAW_SCHEMA struct (malformed -> NULL, never a job failure)."""
    return F.from_json(line, RAW_SCHEMA, {"mode": "PERMISSIVE"})


# ---- helpers ------------------------------------------------------------------------------------

def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def _f(c: Column) -> Column:
    return F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))


def _floats(*cols: Column) -> Column:
    return F.array(*[_f(c) for c in cols])


def _empty_struct(s: Column, fields: list[str]) -> Column:
    return s.isNull() | (F.greatest(*[s[f].isNotNull().cast("int") for f in fields]) == 0)


# ---- blocks -------------------------------------------------------------------------------------

def general_vec(g: Column) -> Column:
    """7: size, entropy, is_pe, start bytes."""
    sb = g["start_bytes"]
    return _floats(g["size"], g["entropy"], g["is_pe"], sb[0], sb[1], sb[2], sb[3])


def histogram_vec(h: Column, dim: int = 256) -> Column:
    """256: counts / sum (zeros when missing)."""
    return F.when(F.coalesce(F.size(h), F.lit(0)) <= 0, zeros(dim)).otherwise(normalize_counts(h))


def strings_vec(s: Column) -> Column:
    """177: numstrings, avlength, printables, 96-bin distribution / printables, entropy, 77 indicator counts."""
    div = F.when(F.coalesce(s["printables"], F.lit(0)) > 0, s["printables"].cast("double")).otherwise(F.lit(1.0))
    dist = F.transform(F.coalesce(s["printabledist"], F.array_repeat(F.lit(0.0), 96)), lambda x: (x / div).cast("float"))
    counts = F.coalesce(s["string_counts"], F.create_map().cast("map<string,bigint>"))
    v = F.concat(_floats(s["numstrings"], s["avlength"], s["printables"]), dist, _floats(s["entropy"]), ioc_vector(counts))
    return F.when(s.isNull(), zeros(177)).otherwise(v)


def _vocab_index(x: Column, vocab: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in vocab]), x) - 1


def header_vec(h: Column) -> Column:
    """74: 5 COFF scalars, machine and subsystem as vocabulary index (unknown -> 0),
    23 optional scalars, 16 + 11 flag one-hots, 17 DOS members."""
    coff, opt, dos = h["coff"], h["optional"], h["dos"]
    machine = F.greatest(_vocab_index(coff["machine"], MACHINE_TYPES), F.lit(0))
    subsystem = F.greatest(_vocab_index(opt["subsystem"], SUBSYSTEM_TYPES), F.lit(0))
    ch = F.coalesce(coff["characteristics"], F.array().cast("array<string>"))
    dch = F.coalesce(opt["dll_characteristics"], F.array().cast("array<string>"))
    v = F.concat(
        _floats(*[coff[f] for f in COFF_SCALARS], machine, subsystem, *[opt[f] for f in OPTIONAL_SCALARS]),
        _floats(*[F.array_contains(ch, c) for c in IMAGE_CHARACTERISTICS]),
        _floats(*[F.array_contains(dch, c) for c in DLL_CHARACTERISTICS]),
        _floats(*[dos[m] for m in DOS_MEMBERS]))
    empty = h.isNull() | (coff.isNull() & opt.isNull() & dos.isNull())
    return F.when(empty, zeros(74)).otherwise(v)


def section_stats(sec: Column) -> Column:
    """``ft_section_stats``: the 11 general section numbers."""
    ss = F.coalesce(sec["sections"], F.array().cast(SECTION_SCHEMA["sections"].dataType))
    ov = sec["overlay"]
    def props(s):
        return F.coalesce(s["props"], F.array().cast("array<string>"))
    ent = F.concat(F.transform(ss, lambda s: s["entropy"]), F.array(F.coalesce(ov["entropy"], F.lit(0.0)), F.lit(0.0)))
    sr = F.concat(F.transform(ss, lambda s: s["size_ratio"]), F.array(F.coalesce(ov["size_ratio"], F.lit(0.0)), F.lit(0.0)))
    vr = F.concat(F.transform(ss, lambda s: s["vsize_ratio"]), F.array(F.lit(0.0)))
    return _floats(
        F.size(ss), F.size(F.filter(ss, lambda s: s["size"] == 0)), F.size(F.filter(ss, lambda s: s["name"] == "")),
        F.size(F.filter(ss, lambda s: F.array_contains(props(s), "MEM_READ") & F.array_contains(props(s), "MEM_EXECUTE"))),
        F.size(F.filter(ss, lambda s: F.array_contains(props(s), "MEM_WRITE"))),
        F.array_max(ent), F.array_min(ent), F.array_max(sr), F.array_min(sr), F.array_max(vr), F.array_min(vr))


def section_tokens(sec: Column):
    """The hashed inputs of the section block: three (name, number) pair lists,
    the ``name:prop`` strings and the entry name."""
    ss = F.coalesce(sec["sections"], F.array().cast(SECTION_SCHEMA["sections"].dataType))
    def pairs(field):
        return F.transform(ss, lambda s: F.struct(F.coalesce(s["name"], F.lit("")).alias("k"), s[field].cast("double").alias("v")))
    chars = F.flatten(F.transform(ss, lambda s: F.transform(F.coalesce(s["props"], F.array().cast("array<string>")),
                                                             lambda p: F.concat(s["name"], F.lit(":"), p))))
    return pairs("size"), pairs("vsize"), pairs("entropy"), chars, F.array(F.coalesce(sec["entry"], F.lit("")))


def section_hash_inputs(sec: Column):
    """(kind, tokens, width, signed) of the five hashed section lists."""
    p_size, p_vsize, p_ent, chars, entry = section_tokens(sec)
    return [("pairs", p_size, 50, True), ("pairs", p_vsize, 50, True), ("pairs", p_ent, 50, True),
            ("strings", chars, 50, True), ("strings", entry, 10, True)]


def section_vec(sec: Column, mode: str = "murmur", hashed: list[Column] | None = None) -> Column:
    """224: 11 stats, 4 x 50 hashed lists, 10 hashed entry name, overlay triple."""
    hashed = hashed or [_hash_inline(k, t, n, sg, mode) for k, t, n, sg in section_hash_inputs(sec)]
    ov = sec["overlay"]
    v = F.concat(section_stats(sec), *hashed, _floats(ov["size"], ov["size_ratio"], ov["entropy"]))
    return F.when(sec.isNull() | sec["sections"].isNull(), zeros(224)).otherwise(v)


def _hash_inline(kind: str, tokens: Column, n: int, signed: bool, mode: str) -> Column:
    hp, hsx = _hashers(mode)
    return hp(tokens, n, signed) if kind == "pairs" else hsx(tokens, n, signed)


def _hashers(mode: str):
    if mode == "md5":
        return (lambda p, n, s: hs.feature_hash_sql(p, n, s),
                lambda t, n, s: hs.feature_hash_sql(hs.string_pairs(t), n, s))
    return (lambda p, n, s: hs.feature_hash_pairs(p, n, s),
            lambda t, n, s: hs.feature_hash_strings(t, n, s))


def distinct_libraries(imports: Column) -> Column:
    """``set_distinct_libs``: distinct lower-cased library names of an imports map."""
    return F.array_distinct(F.transform(F.map_keys(imports), lambda k: F.lower(k)))


def import_tokens(imports: Column) -> Column:
    """``lib:func`` strings with the library lower-cased (duplicates kept)."""
    return F.flatten(F.transform(F.map_entries(imports), lambda e: F.transform(
        F.coalesce(e["value"], F.array().cast("array<string>")), lambda fn: F.concat(F.lower(e["key"]), F.lit(":"), fn))))


def imports_hash_inputs(imports: Column):
    return [("strings", distinct_libraries(imports), 256, False), ("strings", import_tokens(imports), 1024, False)]


def imports_vec(imports: Column, mode: str = "murmur", hashed: list[Column] | None = None) -> Column:
    """1282: n functions, n distinct libraries, 256 library hash, 1024 function hash (unsigned)."""
    hashed = hashed or [_hash_inline(k, t, n, sg, mode) for k, t, n, sg in imports_hash_inputs(imports)]
    v = F.concat(_floats(F.size(import_tokens(imports)), F.size(distinct_libraries(imports))), *hashed)
    return F.when(F.coalesce(F.size(imports), F.lit(0)) <= 0, zeros(1282)).otherwise(v)


def exports_hash_inputs(exports: Column):
    return [("strings", exports, 128, True)]


def exports_vec(exports: Column, mode: str = "murmur", compat: bool = True, hashed: list[Column] | None = None) -> Column:
    """129: first slot 128 in compat mode (the length of the hashed vector), the
    export count otherwise; then a 128 signed hash."""
    hashed = hashed or [_hash_inline(k, t, n, sg, mode) for k, t, n, sg in exports_hash_inputs(exports)]
    first = F.lit(128.0) if compat else F.size(exports)
    v = F.concat(_floats(first), *hashed)
    return F.when(F.coalesce(F.size(exports), F.lit(0)) <= 0, zeros(129)).otherwise(v)


def datadirectories_vec(dd: Column, skip_last: bool = True) -> Column:
    """34: (size, virtual address) per named directory, then the two reloc flags of
    element 0. Compat: entries 1..n-2 are read (the last directory is skipped)."""
    n = F.size(dd)
    entries = F.slice(dd, 2, F.greatest(n - (2 if skip_last else 1), F.lit(0)))
    cells = []
    for name in DATA_DIRECTORY_NAMES:
        hit = F.try_element_at(F.filter(entries, _named(name)), F.lit(-1))
        cells += [hit["size"], hit["virtual_address"]]
    first = F.try_element_at(dd, F.lit(1))
    v = _floats(*cells, first["has_relocs"], first["has_dynamic_relocs"])
    return F.when(F.coalesce(n, F.lit(0)) <= 0, zeros(34)).otherwise(v)


def _named(name: str):
    return lambda e: e["name"] == F.lit(name)


def richheader_hash_inputs(rh: Column):
    n = F.size(rh)
    idx = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(2))
    pairs = F.transform(F.filter(idx, lambda i: i + 1 < n),
                        lambda i: F.struct(F.try_element_at(rh, i + 1).cast("string").alias("k"),
                                           F.try_element_at(rh, i + 2).cast("double").alias("v")))
    return [("pairs", pairs, 32, True)]


def richheader_vec(rh: Column, mode: str = "murmur", hashed: list[Column] | None = None) -> Column:
    """33: number of pairs, 32 signed hash of (str(v[i]) -> v[i+1])."""
    hashed = hashed or [_hash_inline(k, t, n, sg, mode) for k, t, n, sg in richheader_hash_inputs(rh)]
    n = F.size(rh)
    v = F.concat(_floats(F.floor(n / 2)), *hashed)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, zeros(33)).otherwise(v)


def authenticode_vec(a: Column) -> Column:
    """8 numbers in field order."""
    return F.when(_empty_struct(a, AUTHENTICODE_FIELDS), zeros(8)).otherwise(_floats(*[a[f] for f in AUTHENTICODE_FIELDS]))


def warnings_vec(w: Column) -> Column:
    """88: one-hot over the catalogue of normalised warnings, then their count."""
    from .warnings import CATALOGUE
    v = F.concat(_floats(*[F.array_contains(w, e) for e in CATALOGUE]), _floats(F.size(w)))
    return F.when(F.coalesce(F.size(w), F.lit(0)) <= 0, zeros(88)).otherwise(v)


HASH_INPUTS = {
    "section": lambda r: section_hash_inputs(r["section"]),
    "imports": lambda r: imports_hash_inputs(r["imports"]),
    "exports": lambda r: exports_hash_inputs(r["exports"]),
    "richheader": lambda r: richheader_hash_inputs(r["richheader"]),
}


# Hashed lists per block, in slot order: widths.
HASH_WIDTHS = {"section": [50, 50, 50, 50, 10], "imports": [256, 1024], "exports": [128], "richheader": [32]}
HASH_SIGNED = {"section": [True] * 5, "imports": [False, False], "exports": [True], "richheader": [True]}


def _block_token_lists(block: str, v) -> list[list[tuple[str, float]]]:
    """Python twin of the token rules above, for one raw block value."""
    if block == "section":
        secs = (v or {}).get("sections") if isinstance(v, dict) else None
        secs = list(secs) if secs is not None else []
        def num(x):
            return float(x) if x is not None else 0.0
        names = [(s.get("name") or "") for s in secs]
        chars = [(f"{nm}:{p}", 1.0) for nm, s in zip(names, secs)
                 for p in (s.get("props") if s.get("props") is not None else [])]
        entry = (v or {}).get("entry") if isinstance(v, dict) else None
        return [[(nm, num(s.get("size"))) for nm, s in zip(names, secs)],
                [(nm, num(s.get("vsize"))) for nm, s in zip(names, secs)],
                [(nm, num(s.get("entropy"))) for nm, s in zip(names, secs)],
                chars, [(entry or "", 1.0)]]
    if block == "imports":
        items = list(v.items()) if isinstance(v, dict) else list(v) if v is not None else []
        libs = sorted({k.lower() for k, _ in items})
        funcs = [(k.lower() + ":" + f, 1.0) for k, fs in items for f in (fs if fs is not None else [])]
        return [[(x, 1.0) for x in libs], funcs]
    if block == "exports":
        return [[(x, 1.0) for x in (list(v) if v is not None else []) if x is not None]]
    if block == "richheader":
        vals = list(v) if v is not None else []
        return [[(str(vals[i]), float(vals[i + 1])) for i in range(0, len(vals) - 1, 2)]]
    raise ValueError(block)


def pe_hash_udf(blocks: list[str]):
    """Arrow UDF: struct of raw blocks -> concatenated Murmur3 hashed vectors."""

    width = sum(sum(HASH_WIDTHS[b]) for b in blocks)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _pe_hashes(frame: pa.Array) -> pa.Array:
        def vectors(rows):
            parts = []
            for b in blocks:
                lists = [_block_token_lists(b, r[b]) for r in rows]
                for j, (n, signed) in enumerate(zip(HASH_WIDTHS[b], HASH_SIGNED[b])):
                    parts.append(hs.hash_rows([ls[j] for ls in lists], n, signed))
            return np.concatenate(parts, axis=1)
        return hs.in_pieces(frame, width, vectors)
    return _pe_hashes


def block_vec(raw: Column, block: str, mode: str = "murmur", hashed: list[Column] | None = None) -> Column:
    """Vector of one block from the raw record."""
    if block == "general":
        return general_vec(raw["general"])
    if block in ("histogram", "byteentropy"):
        return histogram_vec(raw[block])
    if block == "strings":
        return strings_vec(raw["strings"])
    if block == "header":
        return header_vec(raw["header"])
    if block == "section":
        return section_vec(raw["section"], mode, hashed)
    if block == "imports":
        return imports_vec(raw["imports"], mode, hashed)
    if block == "exports":
        return exports_vec(raw["exports"], mode, hashed=hashed)
    if block == "datadirectories":
        return datadirectories_vec(raw["datadirectories"])
    if block == "richheader":
        return richheader_vec(raw["richheader"], mode, hashed)
    if block == "authenticode":
        return authenticode_vec(raw["authenticode"])
    if block == "pefilewarnings":
        return warnings_vec(raw["pefilewarnings"])
    raise ValueError(f"unknown block {block!r}")


def block_names(blocks: list[str] | None = None) -> list[str]:
    return [b for b, _ in BLOCK_DIMS if blocks is None or b in blocks]


def with_block_vectors(df, raw: str = "raw", blocks: list[str] | None = None, mode: str = "murmur",
                       prefix: str = "v_"):
    """Adds one ARRAY<FLOAT> column per block (``v_<block>``).

    In murmur mode all hash inputs go to one Arrow UDF evaluated as a
    top-level column (a Python UDF is not evaluated inside a CASE branch, and
    several UDFs with lambda-built inputs in one projection are not planned);
    empty token lists hash to zeros."""
    r = F.col(raw)
    out = df
    hashed: dict[str, list[Column]] = {}
    hb = [b for b in block_names(blocks) if b in HASH_WIDTHS] if mode == "murmur" else []
    if hb:
        # one Arrow UDF over the raw blocks (plain field references) as a top-level column
        out = out.withColumn("__hashed", pe_hash_udf(hb)(F.struct(*[r[b].alias(b) for b in hb])))
        pos = 1
        for b in hb:
            for n in HASH_WIDTHS[b]:
                hashed.setdefault(b, []).append(F.slice(F.col("__hashed"), pos, n))
                pos += n
    for b in block_names(blocks):
        out = out.withColumn(f"{prefix}{b}", block_vec(r, b, mode, hashed.get(b)))
    return out.drop("__hashed")


def assemble(df, raw: str = "raw", blocks: list[str] | None = None, mode: str = "murmur", out: str = "features"):
    """``ft_assemble`` / ``ft_block_subset``: the blocks' vectors concatenated in the
    fixed order (all twelve by default) -> ARRAY<FLOAT>."""
    names = block_names(blocks)
    v = with_block_vectors(df, raw, blocks, mode)
    return v.withColumn(out, F.concat(*[F.col(f"v_{b}") for b in names])).drop(*[f"v_{b}" for b in names])


def block_dim(blocks: list[str] | None = None) -> int:
    return sum(d for b, d in BLOCK_DIMS if blocks is None or b in blocks)


CATEGORICAL_FEATURES = [2, 3, 4, 5, 6, 701, 702]
#: Values of those slots: the image flag, four bytes, and places in the two vocabularies.
CATEGORICAL_VALUES = dict(zip(CATEGORICAL_FEATURES, [2, 256, 256, 256, 256, len(MACHINE_TYPES), len(SUBSYSTEM_TYPES)]))
