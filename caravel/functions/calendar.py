"""Calendar arithmetic on DATE and zone-less TIMESTAMP columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report grains and the unit each one truncates to.
GRAINS = {"day": None, "week": "week", "month": "MM"}


def period_start(day: Column, grain: str) -> Column:
    """First day of the period that holds ``day``; weeks start on Monday."""
    unit = GRAINS[grain]
    return day if unit is None else F.trunc(day, unit)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def months_apart(earlier: Column, later: Column) -> Column:
    """Number of month boundaries between two dates (whole months would undercount)."""
    return ((F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))).cast("bigint")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def midnight(day: Column) -> Column:
    """The instant a day starts, zone-less, so that day bounds can be put on the timestamp column."""
    return day.cast("date").cast("timestamp_ntz")
