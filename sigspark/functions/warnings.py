"""PE parser warnings: normalisation against the catalogue and the catalogue table.

A raw warning text is mapped to a catalogue entry: entries written
"...text" match by suffix and are tried first, entries "text..." match by
prefix; unknown texts are dropped. The result per file is the sorted
distinct list of entries. When several entries of the same kind match, the
first in catalogue order wins (deterministic).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): the warning catalogue, one entry
# per line in its original order; the position is the vector slot.
# ---------------------------------------------------------------------------
CATALOGUE = [
    "AddressOfEntryPoint lies outside the sections' boundaries...",
    'Bad RVA in relocation data...',
    'Byte 0x...',
    'Corrupt header...',
    'Damaged Import Table information...',
    "Don't know how to parse LOAD_CONFIG information for non-PE32...",
    'Error, too many imported symbols...',
    'Error parsing a resource directory data entry...',
    'Error parsing export directory at RVA...',
    'Error parsing resource of type RT_STRING at...',
    'Error parsing StringFileInfo/VarFileInfo struct...',
    'Error parsing the Delay import directory...',
    'Error parsing the Delay import directory at RVA...',
    'Error parsing the import directory at RVA...',
    'Error parsing the import directory. Invalid Import data at RVA...',
    'Error parsing the import table. Entries go beyond bounds...',
    'Error parsing the import table. AddressOfData overlaps with THUNK_DATA for THUNK at RVA...',
    'Error parsing the import table. Invalid data at RVA...',
    'Error parsing the resources directory. Excessively nested table depth...',
    'Error parsing the resources directory. The directory contains...',
    'Error parsing the resources directory. The file contains at least...',
    'Error parsing the resources directory. Entry...',
    'Error parsing the resources directory, attempting to read entry name. Entry names overlap...',
    "Error parsing the resources directory, attempting to read entry name. Can't read unicode string at offset...",
    'Error parsing the version information, attempting to read OffsetToData with RVA...',
    'Error parsing the version information, attempting to read VS_VERSION_INFO string...',
    'Error parsing the version information, attempting to read VarFileInfo Var string...',
    'Error parsing the version information, attempting to read StringFileInfo string...',
    'Error parsing the version information, attempting to read StringTable string...',
    'Error parsing the version information, attempting to read StringTable Key string...',
    'Error parsing the version information, to read StringTable Value string...',
    'Excessive number of imports...',
    'Export directory contains more than 10 repeated entries...',
    'Failed parsing FunctionEntry of UNWIND_INFO at...',
    'Failed rendering pascal string, attempting to read from RVA 0x...',
    'Failed rendering unicode string, attempting to read from RVA 0x...',
    'Failed to process directory...',
    'FunctionEntry of UNWIND_INFO at...',
    'If SectionAlignment...',
    'If FileAlignment > 0x200 it should be a power of 2. Value...',
    'Imported symbols contain entries typical of packed executables...',
    'Invalid bdd dynamic relocation...',
    'Invalid bdd info...',
    'Invalid debug information...',
    'Invalid function override header...',
    'Invalid function override info...',
    'Invalid IMAGE_DYNAMIC_RELOCATION_TABLE information...',
    'Invalid LOAD_CONFIG information...',
    "Invalid relocation information. Can't read...",
    'Invalid relocation information. SizeOfBlock too large...',
    'Invalid relocation information. VirtualAddress outside...',
    "Invalid resources directory. Can't read...",
    "Invalid resources directory. Can't parse directory data at RVA...",
    "Invalid TLS information. Can't read...",
    'Invalid type 0x...',
    'Invalid VS_VERSION_INFO block...',
    'No parsing available for IMAGE_DYNAMIC_RELOCATION_TABLE...',
    'Overlapping offsets in relocation data...',
    'Possibly corrupt file. AddressOfEntryPoint lies outside the file...',
    'Relocating image but PE does not have (or pefile cannot parse) a DIRECTORY_ENTRY_BASERELOC...',
    'Resource size...',
    'Rich Header is malformed...',
    'Rich Header is not in Microsoft format, possibly malformed...',
    'RVA AddressOfFunctions in the export directory points to an invalid...',
    'RVA AddressOfNames in the export directory points to an invalid...',
    'RVA of IMAGE_BOUND_IMPORT_DESCRIPTOR points...',
    'SizeOfHeaders is smaller than AddressOfEntryPoint...',
    'Suspicious flags set for section...',
    'Suspicious NumberOfRvaAndSizes in the Optional Header...',
    'Suspicious value found parsing section...',
    "The Bound Imports directory exists but can't be parsed...",
    'Too many warnings parsing section. Aborting...',
    'Too many errors parsing the Delay import directory...',
    'Too many errors parsing the import directory...',
    'Too many sections...',
    'Unknown UNWIND_CODE at...',
    'Unsupported version of UNWIND_INFO...',
    '...Contents are null-bytes.',
    "...No data in the file (is this corkami's virtsectblXP?).",
    '...PointerToRawData points beyond the end of the file.',
    '...PointerToRawData should normally be a multiple of FileAlignment, this might imply the file is trying to confuse tools which parse this incorrectly.',
    '...SizeOfRawData is larger than file.',
    '...VirtualSize is extremely large > 256MiB',
    '...VirtualAddress is beyond 0x10000000',
    '...symbol entries. Assuming corrupt.',
    '...ordinal entries. Assuming corrupt.',
    '...Assuming corrupt.',
]

SUFFIXES = [e[3:] for e in CATALOGUE if e.startswith("...")]
PREFIXES = [e[:-3] for e in CATALOGUE if not e.startswith("...")]


def normalize_warning(w: Column) -> Column:
    """``ft_warning_normalize`` for one warning text -> catalogue entry or NULL."""
    suf = F.array(*[F.lit(s) for s in SUFFIXES])
    pre = F.array(*[F.lit(p) for p in PREFIXES])
    s_hit = F.try_element_at(F.filter(suf, lambda s: w.endswith(s)), F.lit(1))
    p_hit = F.try_element_at(F.filter(pre, lambda p: w.startswith(p)), F.lit(1))
    return (F.when(s_hit.isNotNull(), F.concat(F.lit("..."), s_hit))
             .when(p_hit.isNotNull(), F.concat(p_hit, F.lit("..."))))


def normalize_warnings(ws: Column) -> Column:
    """Raw warnings of a file -> sorted distinct catalogue entries (unknown dropped)."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ws, normalize_warning), lambda x: x.isNotNull())))


def catalogue_table(spark: SparkSession) -> DataFrame:
    """(warning_id, entry, kind) as a small table."""
    rows = [(i, e, "suffix" if e.startswith("...") else "prefix") for i, e in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "warning_id int, entry string, kind string")
