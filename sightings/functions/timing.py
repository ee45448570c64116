"""Clock helpers. Timestamps may be with or without time zone; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightings.functions.columns import as_column

HOUR = 3600


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(as_column(ts).cast("timestamp"))


def time_bucket(ts: Column | str, seconds: int = HOUR) -> Column:
    """Number of the fixed-width time slice that holds `ts`."""
    return F.floor(F.unix_seconds(as_column(ts).cast("timestamp")) / F.lit(seconds))


def is_small_hours(ts: Column | str) -> Column:
    """From midnight up to, not including, six."""
    return F.hour(as_column(ts)) < 6


def mode(night_on: Column, present: Column) -> Column:
    """Household mode; the night switch takes precedence over presence."""
    return F.when(night_on, "night").when(present, "home").otherwise("away")
