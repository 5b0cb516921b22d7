"""Helpers over semi-structured record values (``VARIANT``).

Raw records are parsed once with ``try_parse_json`` (a bad line gives NULL
instead of failing the job); everything below is a JVM expression on the
VARIANT value, driven by ``schema_of_variant``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"^\s+|\s+$"


def vtype(v: Column) -> Column:
    """Top-level variant type name: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID..."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def nested_get(v: Column, *path: str) -> Column:
    """``prj_nested_get``: value at a key path; NULL when a step is missing or not an object."""
    p = "$" + "".join(f"['{k}']" for k in path)
    return F.try_variant_get(v, p, "variant")


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def value_shape(v: Column) -> Column:
    """``prj_value_shape``: none / string / bool / int / float / list / dict.

    A literal like ``1.0`` parses as a DECIMAL of scale 0 that would fit a BIGINT, an
    integer literal only as one beyond BIGINT; so a small one is a float.
    """
    s = F.schema_of_variant(v)
    t = vtype(v)
    return (F.when(v.isNull() | (t == "VOID"), "none")
             .when(t == "STRING", "string")
             .when(t == "BOOLEAN", "bool")
             .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
             .when((t == "DECIMAL") & s.rlike(r",\s*0\)$") & (F.abs(as_double(v)) >= float(1 << 63)), "int")
             .when(t.isin("DECIMAL", "DOUBLE", "FLOAT"), "float")
             .when(t == "ARRAY", "list")
             .when(t == "OBJECT", "dict")
             .otherwise(F.lower(t)))


#: Levels of nested lists that ``normalize_labels`` flattens.
LIST_LEVELS = 6


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(s, _WS, "")


def is_nonempty(v: Column) -> Column:
    """``prd_nonempty``: NULL, JSON null, NaN, blank string, empty array/object -> false."""
    t = vtype(v)
    return (F.when(v.isNull() | (t == "VOID"), False)
             .when(t == "STRING", _trimmed(as_string(v)) != "")
             .when(t == "ARRAY", F.size(as_array(v)) > 0)
             .when(t == "OBJECT", F.size(F.map_keys(as_object(v))) > 0)
             .when(t.isin("DOUBLE", "FLOAT"), ~F.isnan(as_double(v)))
             .otherwise(True))


def detection_ratio(v: Column) -> Column:
    """``prj_detection_ratio``: struct(hits, total). "h/t" -> both (or neither when
    one side is not a number); a plain number -> (v, NULL); anything else -> NULLs."""
    t = vtype(v)
    s = as_string(v)
    h = F.lit(None).cast("double")
    lhs = F.split_part(s, F.lit("/"), F.lit(1))
    rhs = F.substring(s, F.instr(s, "/") + 1, 1 << 30)  # everything after the first '/'
    lnum, rnum = _num(lhs), _num(rhs)
    both = lnum.isNotNull() & rnum.isNotNull()
    hits = (F.when((t == "STRING") & s.contains("/"), F.when(both, lnum))
             .when(t == "STRING", _num(s))
             .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), as_double(v))
             .otherwise(h))
    total = F.when((t == "STRING") & s.contains("/") & both, rnum).otherwise(h)
    return F.struct(hits.alias("hits"), total.alias("total"))


def _num(s: Column) -> Column:
    """A decimal number text as DOUBLE; NULL for Java's suffixed literals such as ``5f``."""
    t = _trimmed(s)
    number = t.rlike(r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$")
    return F.when(number, t.try_cast("double"))


def _py_str(v: Column) -> Column:
    """str() of a scalar the way the reference prints it (True/False capitalised)."""
    t = vtype(v)
    return (F.when(t == "BOOLEAN", F.initcap(as_string(v)))
             .when((t == "DECIMAL") & (value_shape(v) == "float") & ~as_string(v).contains("."),
                   F.concat(as_string(v), F.lit(".0")))
             .when(t == "DOUBLE", F.regexp_replace(F.regexp_replace(as_string(v), r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-"))
             .otherwise(as_string(v)))


def _scalar_or_dict_labels(v: Column) -> Column:
    t = vtype(v)
    obj = F.map_entries(as_object(v))

    def entry_label(e):
        ev = e["value"]
        et = vtype(ev)
        is_num = et.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
        return (F.when(et == "BOOLEAN", F.when(F.try_variant_get(ev, "$", "boolean"), e["key"]))
                 .when(is_num, F.when(as_double(ev) != 0, F.concat(e["key"], F.lit("="), as_string(ev))))
                 .when(is_nonempty(ev), e["key"]))

    return (F.when(v.isNull() | (t == "VOID"), F.array().cast("array<string>"))
             .when(t == "STRING", F.when(_trimmed(as_string(v)) != "", F.array(_trimmed(as_string(v))))
                   .otherwise(F.array().cast("array<string>")))
             .when(t == "OBJECT", F.filter(F.transform(obj, entry_label), lambda x: x.isNotNull()))
             .when(t == "ARRAY", F.array().cast("array<string>"))
             .otherwise(F.array(_py_str(v))))


def normalize_labels(v: Column) -> Column:
    """``prj_normalize_labels``: scalar -> [str]; object -> true keys / k=v for non-zero
    numbers / keys with non-empty values; arrays flattened to ``LIST_LEVELS`` levels, empties
    dropped. A list nested deeper gives NULL as a whole (``labels_too_deep`` tells it from a missing value), so that
    one odd record neither ends the job nor loses some of its labels unseen."""
    def labels(e, levels):
        if not levels:
            return F.when(vtype(e) != "ARRAY", _scalar_or_dict_labels(e))        # NULL; so is what it is flattened into
        inner = F.flatten(F.transform(as_array(e), lambda x: labels(x, levels - 1)))
        return F.when(vtype(e) == "ARRAY", inner).otherwise(_scalar_or_dict_labels(e))

    return F.when(vtype(v) == "ARRAY", F.filter(labels(v, LIST_LEVELS), lambda x: x != "")).otherwise(_scalar_or_dict_labels(v))


def labels_too_deep(v: Column) -> Column:
    """True for a label list nested deeper than ``LIST_LEVELS``: count these beside the labels."""
    return F.coalesce(vtype(v) == "ARRAY", F.lit(False)) & normalize_labels(v).isNull()
