"""Dotted paths as column expressions.

Database paths are ``db.schema.field[.sub|[*]]``, object paths ``_obj[.sub|[*]]``, service paths ``service.method.name[.sub]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_path(p: Column) -> Column:
    """All but the last segment; null for a path of one segment."""
    return F.when(p.contains("."), F.regexp_extract(p, r"(?s)^(.*)(\.[^.]*)$", 1))


def last_segment(p: Column) -> Column:
    """The last segment with its dot; null for a path of one segment."""
    return F.when(p.contains("."), F.regexp_extract(p, r"(?s)^(.*)(\.[^.]*)$", 2))


def is_prefix(upper: Column, lower: Column, strict: bool = True, segment_aware: bool = False) -> Column:
    """``upper`` begins ``lower``; raw string comparison unless segments are asked for."""
    out = F.startswith(lower, upper)
    if segment_aware:
        out = out & (F.substring(lower, F.length(upper) + 1, F.lit(1)).isin("", ".", "["))
    return out & (upper != lower) if strict else out


def remainder(upper: Column, lower: Column) -> Column:
    """What ``lower`` adds to its prefix ``upper``; null if it is none."""
    return F.when(F.startswith(lower, upper), F.substring(lower, F.length(upper) + 1, F.length(lower)))


def ancestors(p: Column, inclusive: bool = False) -> Column:
    """All upper paths, shortest first: explode and equi-join instead of joining on prefixes."""
    parts = F.split(p, r"\.")
    last = F.size(parts) - (0 if inclusive else 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def database_name(p: Column) -> Column:
    return F.split(p, r"\.")[0]


def schema_name(p: Column) -> Column:
    """Second segment without a trailing element mark."""
    return F.regexp_replace(F.try_element_at(F.split(p, r"\."), F.lit(2)), r"\[\*\]$", "")


def field_name(p: Column) -> Column:
    """What follows two dots, or the whole path."""
    parts = F.split(p, r"\.", 3)
    return F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(3))).otherwise(p)


def append_suffix(p: Column, suffix: Column) -> Column:
    return F.concat(p, suffix)


def insert_after_field(p: Column, part: Column) -> Column:
    """``part`` goes in right after the third component."""
    shape = r"(?s)^([^.]*\.[^.]*\.[^.\[]*)(.*)$"
    return F.when(F.rlike(p, F.lit(shape)), F.concat(F.regexp_extract(p, shape, 1), part, F.regexp_extract(p, shape, 2))).otherwise(p)


def cut_suffix(p: Column, suffix: Column) -> Column:
    """``p`` without ``suffix`` at its end, if it is there."""
    return F.when(F.endswith(p, suffix), F.substring(p, F.lit(1), F.length(p) - F.length(suffix))).otherwise(p)


def prepend_after_root(p: Column, part: Column) -> Column:
    """``_obj.x`` with ``part`` between root and rest."""
    return F.concat(F.lit("_obj"), part, F.substring(p, F.lit(5), F.length(p)))


def append_to_call(call: Column, suffix: Column) -> Column:
    """A call's path with a part behind it."""
    return F.concat(call, suffix)


def prepend_to_call(call: Column, prefix: Column) -> Column:
    """A call's path with the path of the call around it before it."""
    return F.concat_ws(".", prefix, call)


def trace_argument(p: Column) -> Column:
    """Name of the argument in a service path, without element mark."""
    return F.split(F.try_element_at(F.split(p, r"\.", 4), F.lit(3)), r"\[\*\]")[0]


def trace_object_path(p: Column) -> Column:
    """Object path below the argument.  ``t17[*].X`` gives ``_obj.X``: the mark before a dot is lost."""
    parts = F.split(p, r"\.", 4)
    third = F.try_element_at(parts, F.lit(3))
    at = F.instr(third, "[*]")
    rest = F.when(F.size(parts) == 4, F.concat(F.lit("."), F.try_element_at(parts, F.lit(4)))).when(at > 0, F.substring(third, at, F.length(third))).otherwise(F.lit(""))
    return F.concat(F.lit("_obj"), rest)


def is_upper_taint(path_a: Column, call_a: Column, path_b: Column, call_b: Column) -> Column:
    """The first is an upper path of the second, through the same call."""
    return is_prefix(path_a, path_b) & (call_a == call_b)


def resolve_alias(p: Column, alias: Column) -> Column:
    """Canonical path of a field known under another name."""
    return F.coalesce(alias, p)


def cache_namespace(key: Column) -> Column:
    """Namespace of a cache key built as ``key + ":suffix"``, ``*`` if there is none."""
    found = F.regexp_extract(key, r":([^:]+)$", 1)
    return F.when(found != "", found).otherwise(F.lit("*"))
