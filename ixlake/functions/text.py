"""Text, number and time expressions used by the extractors, feeds and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def or_default(value: Column, default: str | Column) -> Column:
    """Default for a missing or empty text."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def prefix(value: Column, length: int = 8) -> Column:
    return F.substring(value, 1, length)


def short_id(value: Column, length: int = 8) -> Column:
    """Leading characters and an ellipsis; ``-`` when there is no id."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("-")).otherwise(
        F.concat(prefix(value, length), F.lit("..."))
    )


def number_label(value: Column) -> Column:
    """Thousands separators and at most four decimals."""
    return F.regexp_replace(F.format_number(value.try_cast("double"), 4), r"\.?0+$", "")


def iso_label(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmmZ``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z"))


def table_name(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.lower(name))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less or zoned time (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_int(value: object, default: int) -> int:
    """Leading integer of a request parameter, else the default."""
    if isinstance(value, bool) or value is None:
        return default
    if isinstance(value, int):
        return value
    found = re.match(r"\s*([+-]?\d+)", str(value))
    return int(found.group(1)) if found else default
