"""Printable strings of file content and the string-indicator (IOC) counts.

Strings are extracted JVM-side with ``regexp_extract_all`` on an ISO-8859-1
decode of the bytes (one char per byte). Each
indicator value is the number of *strings* that match its pattern
(``size(filter(strings, s -> s rlike p))``), not the number of matches. An
Arrow UDF first tells which indicators' texts a file holds at all; only those
are counted string by string.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes as fb

PRINTABLE_RUN = r"[\x20-\x7f]{5,}"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): string-indicator names and
# patterns in their original order; "i" marks a case-insensitive pattern.
# Deviations from the literal source text, needed by the Java regex dialect:
#   * url: the "[" inside the character class is escaped as "\[".
# Quirks kept on purpose: email_addr repeats the mac_addr pattern, the
# registry pattern reads "KHEY_|KHLM", ".click" has an unescaped dot, and the
# "onlick" name is spelled as in the original.
# ---------------------------------------------------------------------------
IOC_PATTERNS: list[tuple[str, str, bool]] = [
    ("url", r"\b(?:http|https|ftp):\/\/[a-zA-Z0-9-._~:?#\[\]@!$&'()*+,;=]+", False),
    ("ipv4_addr", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False),
    ("ipv6_addr", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b|\b(?:[A-Fa-f0-9]{1,4}:){1,7}:\b|\b:[A-Fa-f0-9]{1,4}(?::[A-Fa-f0-9]{1,4}){1,6}\b", False),
    ("mac_addr", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b", False),
    ("email_addr", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b", False),
    ("btc_wallet", r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}", False),
    ("file_path", r"\bC:/", False),
    ("dos_msg", r"!This program ", False),
    ("registry_key", r"\b(?:KHEY_|KHLM|HKCU)", False),
    ("/dev/", r"/dev/", False),
    ("/proc/", r"/proc/", False),
    ("/bin/", r"/bin/", False),
    ("/usr/", r"/usr/", False),
    ("/tmp/", r"/tmp/", False),
    ("/URI", r"/URI", False),
    ("/FlateDecode", r"/FlateDecode", False),
    ("/EmbeddedFile", r"/EmbeddedFile", False),
    ("html", r"html", True),
    ("javascript", r"javascript", True),
    ("<script", r"<script", True),
    (".click(", r".click", True),
    ("onlick", r"onclick", True),
    ("powershell", r"powershell", True),
    ("Invoke-Expression", r"Invoke-Expression", False),
    ("Invoke-Command", r"Invoke-Command", False),
    ("Start-process", r"Start-process", False),
    ("get", r"GET /", True),
    ("post", r"POST /", True),
    ("http", r"HTTP/", True),
    ("http://", r"http://", True),
    ("https://", r"https://", True),
    ("ftp", r"ftp:", True),
    ("useragent", r"User-Agent", True),
    ("cookie", r"cookie", True),
    ("internet", r"internet", True),
    ("download", r"download", True),
    ("connect", r"connect", True),
    ("base64", r"base64", True),
    ("base64string", r"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False),
    ("crypt", r"crypt", False),
    ("encode", r"encode", True),
    ("decode", r"decode", True),
    ("cache", r"cache", True),
    ("certificate", r"certificate", True),
    ("clipboard", r"clipboard", True),
    ("command", r"command", True),
    ("create", r"create", True),
    ("debug", r"debug", True),
    ("delete", r"delete", True),
    ("desktop", r"desktop", True),
    ("directory", r"directory", True),
    ("disk", r"disk", True),
    ("environment", r"environment", True),
    ("enum", r"enum", True),
    ("exit", r"exit", True),
    ("file", r"file", True),
    ("hostname", r"hostname", True),
    ("install", r"install", True),
    ("hidden", r"hidden", True),
    ("keyboard", r"keyboard", True),
    ("memory", r"memory", True),
    ("module", r"module", True),
    ("mutex", r"mutex", True),
    ("password", r"password", True),
    ("privilege", r"privilege", True),
    ("process", r"process", True),
    ("remote", r"remote", True),
    ("resource", r"resource", True),
    ("security", r"security", True),
    ("service", r"service", True),
    ("shell", r"shell", True),
    ("snapshot", r"snapshot", True),
    ("system", r"system", True),
    ("thread", r"thread", True),
    ("token", r"token", True),
    ("wallet", r"wallet", True),
    ("window", r"window", True),
]

#: Cheap tests without which a pattern cannot match (any one of them has to hold), so that few strings reach the pattern
#: itself: texts that every match contains, a simpler pattern of its inside, or (of ignored case) a lower-cased text.
NEEDS = {
    "url": ("://",),
    "ipv6_addr": (":",),
    "file_path": ("C:/",),
    "registry_key": ("KHEY_", "KHLM", "HKCU"),
    "base64string": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ",),
    ".click(": ("click",),
}
NEEDS_PATTERN = {
    "ipv4_addr": r"\.[0-9]{1,3}\.",
    "ipv6_addr": r":[0-9A-Fa-f]{0,4}:",
    "mac_addr": r"[:-][0-9A-Fa-f]{2}[:-]",
    "email_addr": r"[:-][0-9A-Fa-f]{2}[:-]",
}

# Vector slot of each indicator: position of its name in sorted order.
IOC_NAMES_SORTED = sorted(name for name, _, _ in IOC_PATTERNS)
IOC_INDEX = {name: i for i, name in enumerate(IOC_NAMES_SORTED)}


def regex(pattern: str, ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + pattern


def text_of_bytes(content: Column) -> Column:
    """One character per byte, so character classes test byte values."""
    return F.decode(content, "ISO-8859-1")


def printable_strings(content: Column) -> Column:
    """All runs of >= 5 bytes in 0x20..0x7f, in order."""
    return F.regexp_extract_all(text_of_bytes(content), F.lit(PRINTABLE_RUN), 0)


_REGEX_META = set("\\.^$*+?{}[]|()")


def is_literal(pattern: str) -> bool:
    return not any(ch in _REGEX_META for ch in pattern)


#: (name, texts, ignore case): one of the texts stands in every string that the indicator counts.
HELD = [(name, tuple((x.lower() if ci else x).encode() for x in ((p,) if is_literal(p) else NEEDS[name])), ci)
        for name, p, ci in IOC_PATTERNS if is_literal(p) or name in NEEDS]
HELD_INDEX = {name: i for i, (name, _, _) in enumerate(HELD)}
_OVERLAP = max(len(x) for _, texts, _ in HELD for x in texts) - 1


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def held_udf(content: pa.Array) -> pa.Array:
    """Whether a file holds one of the texts of each indicator of ``HELD``; bytes in pieces that overlap."""
    out = np.zeros((len(content), len(HELD)), dtype=bool)
    for row, value in zip(out, content):
        if not value.is_valid:
            row[:] = True                   # counted as ever: NULL
            continue
        found, view = [False] * len(HELD), memoryview(value.as_buffer())
        for lo in range(0, len(view), fb.PIECE):
            plain = bytes(view[lo:lo + fb.PIECE + _OVERLAP])
            lowered = plain.lower()
            for i, (_, texts, ci) in enumerate(HELD):
                found[i] = found[i] or any(x in (lowered if ci else plain) for x in texts)
        row[:] = found
    return fb._lists(out)


def _repeated() -> dict[tuple[str, bool], str]:
    """Patterns that stand under several names -> the first of these."""
    first: dict[tuple[str, bool], str] = {}
    for name, p, ci in IOC_PATTERNS:
        first.setdefault((p, ci), name)
    return {k: n for k, n in first.items() if sum((p, ci) == k for _, p, ci in IOC_PATTERNS) > 1}


def _pattern_count(name: str, pattern: str, ignore_case: bool, strings: Column) -> Column:
    """Number of strings that match; those that fail the pattern's cheap tests are not tried."""
    def test(s):
        found = s.rlike(regex(pattern, ignore_case))
        if name in NEEDS_PATTERN:
            found = s.rlike(NEEDS_PATTERN[name]) & found
        if name in NEEDS:
            text = F.lower(s) if ignore_case else s
            found = reduce(lambda a, b: a | b, [text.contains(n) for n in NEEDS[name]]) & found
        return found

    return F.size(F.filter(strings, test)).cast("bigint")


def ioc_counts(strings: Column, lowered: Column | None = None, known: dict[str, Column] | None = None,
               held: Column | None = None) -> Column:
    """Struct of 77 counts: number of strings matching each indicator pattern.

    Patterns without regex syntax are tested with ``contains`` (on the
    lower-cased string for case-insensitive ones); this is exact because the
    strings are ASCII (0x20..0x7f) and Java's ``(?i)`` folds ASCII only.
    Everything else uses ``rlike``, after cheap tests that no match fails.
    ``known``: counts by name that the caller has already; ``held``: ``held_udf`` of the file."""
    if lowered is None:
        lowered = F.transform(strings, lambda s: F.lower(s))
    cols = []
    for name, p, ci in IOC_PATTERNS:
        if name in (known or {}):
            count = known[name]
        elif is_literal(p):
            src, lit = (lowered, p.lower()) if ci else (strings, p)
            count = F.size(F.filter(src, _contains(lit))).cast("bigint")
        else:
            count = _pattern_count(name, p, ci, strings)
        if held is not None and name in HELD_INDEX:
            count = F.when(~held[HELD_INDEX[name]], F.lit(0).cast("bigint")).otherwise(count)
        cols.append(count.alias(name))
    return F.struct(*cols)


def with_ioc_counts(df, content: str = "content", out: str = "iocs"):
    """Adds the indicator-count struct, with the strings, their lower-cased
    copy and the counts of repeated patterns materialised once as columns (an
    expression argument would be re-evaluated by every one of the 77 filters)."""
    d = (df.withColumn("__held", held_udf(F.col(content)))
           .withColumn("__strs", printable_strings(F.col(content)))
           .withColumn("__lstrs", F.transform(F.col("__strs"), lambda s: F.lower(s))))
    shared = _repeated()
    own = {k: f"__n_{i}" for i, k in enumerate(shared)}
    for (p, ci), first in shared.items():
        d = d.withColumn(own[p, ci], _pattern_count(first, p, ci, F.col("__strs")))
    known = {name: F.col(own[p, ci]) for name, p, ci in IOC_PATTERNS if (p, ci) in own}
    return d.withColumn(out, ioc_counts(F.col("__strs"), F.col("__lstrs"), known, F.col("__held"))) \
        .drop("__held", "__strs", "__lstrs", *own.values())


def _contains(lit: str):
    return lambda s: s.contains(lit)


def ioc_count_map(strings: Column) -> Column:
    """``string_counts`` raw form: name -> count for indicators with count > 0."""
    return count_map(ioc_counts(strings))


def count_map(counts: Column) -> Column:
    """Indicator-count struct -> map of the non-zero counts."""
    entries = F.array(*[F.struct(F.lit(n).alias("k"), counts[n].alias("v")) for n in IOC_NAMES_SORTED])
    kept = F.filter(entries, lambda e: e["v"] > 0)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def ioc_vector(string_counts: Column) -> Column:
    """77 floats in sorted-name order from a ``string_counts`` map (missing -> 0)."""
    return F.array(*[
        F.coalesce(string_counts.getItem(n), F.lit(0)).cast("float") for n in IOC_NAMES_SORTED
    ])
