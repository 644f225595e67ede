"""Time functions on zone-less timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries crossed from a to b: sub-second parts of either end are cut off first."""
    whole = lambda c: F.unix_seconds(c.cast("timestamp"))
    return whole(b) - whole(a)


def elapsed_seconds(a: Column, b: Column) -> Column:
    """Elapsed time from a to b in seconds, fractions kept."""
    exact = lambda c: F.unix_micros(c.cast("timestamp"))
    return (exact(b) - exact(a)) / F.lit(1e6)


def hours(h: float) -> Column:
    """An interval of h hours; h may be a fraction."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(h) * 3600.0))


def ts(value: str | datetime) -> Column:
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value.replace("T", " ")
    return F.lit(text).cast("timestamp_ntz")


def strict_timestamp(text: str) -> datetime:
    """``YYYY-MM-DDTHH:MM:SS`` and nothing else."""
    return datetime.strptime(text, "%Y-%m-%dT%H:%M:%S")


def lenient_timestamp(c: Column) -> Column:
    """ISO-like text to a zone-less UTC timestamp; what doesn't parse is null."""
    t = F.trim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6}\d*)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    full = F.regexp_replace(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-]|$)", "$1:00$2"), ",", ".")
    return F.when(iso, F.try_to_timestamp(full).cast("timestamp_ntz"))
