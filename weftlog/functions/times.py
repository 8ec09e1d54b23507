"""Times in the several spellings that logs have; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.text import strip

ZONE = "+08:00"


def iso_time(x: Column, zone: str = ZONE) -> Column:
    """ISO 8601 with ``Z``, a missing hour (``T:30:00``), hour 24 (the next day's 0) or no offset (``zone``)."""
    t = strip(x)
    t = F.regexp_replace(F.regexp_replace(t, r"[zZ]$", "+00:00"), r"T:", "T00:")
    next_day = t.rlike(r"T24:00:00")
    t = F.regexp_replace(t, r"T24:00:00", "T00:00:00")
    t = F.when(t.rlike(r"[+-]\d{2}:?\d{2}$") & t.rlike(r"[T ]\d"), t).otherwise(F.concat(t, F.lit(zone)))
    found = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), t))
    return F.when(next_day, found + F.expr("interval 1 day")).otherwise(found)


def log_time(x: Column, zone: str = ZONE) -> Column:
    """The whole text, else its first 26, 23 or 19 characters, as a time; naive times are of ``zone``."""
    t = strip(x)
    return F.coalesce(*[iso_time(F.substring(t, 1, n), zone) for n in (64, 26, 23, 19)])


def epoch_seconds(x: Column) -> Column:
    return F.unix_micros(x) / 1e6
