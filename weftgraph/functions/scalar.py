"""Scalar expressions of the query surface, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring in any of the columns; null is empty."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())
    return hit


def ratio(part: Column, whole: Column, empty: float, places: int = 4) -> Column:
    """part / whole, rounded; ``empty`` where whole is 0 or null."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(empty))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def safe_int(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("long"), F.lit(0).cast("long"))


def safe_time(c: Column) -> Column:
    """A timestamp, with or without zone (UTC), or null."""
    return F.try_to_timestamp(F.regexp_replace(c.cast("string"), "Z$", "+00:00"))


def normal_path(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit("/"), trimmed))


def module_of_path(c: Column) -> Column:
    """The part before the colon of the first path segment that has one."""
    return F.regexp_extract(c, "(?:^|/)([^/:]*):", 1)


def fill_path(path: Column, params: Column) -> Column:
    """``{name}`` replaced by the value of a map of names."""
    return F.aggregate(F.map_entries(params), path, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def path_parameters(path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(path, F.lit(r"\{([^{}]+)\}"), F.lit(1)))


def clamp(value: object, default: int, most: int) -> int:
    """A limit from what a client sends: bad or not positive gives the default, too large the most."""
    try:
        n = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default
    return min(n, most) if n > 0 else default


def bps_to_gbps(c: Column) -> Column:
    return F.round(c.cast("double") / 1e9, 3)


def all_given(wanted: dict[str, object]) -> Column:
    """The conjunction of what is wanted of columns: nothing for None, blank text and empty lists; a list is membership, a
    pair (low, high) a range with either end open."""
    out = F.lit(True)
    for name, x in wanted.items():
        c = F.col(name)
        if isinstance(x, tuple):
            low, high = x
            out = out & (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
        elif isinstance(x, list):
            out = out & c.isin(x) if x else out
        elif x is not None and str(x).strip():
            out = out & (c == x)
    return out
