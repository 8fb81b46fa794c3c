"""Timestamps in UTC and whole elapsed days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

# Tried in order after the ISO forms a plain cast understands.
EXTRA_FORMATS = (
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
)


def to_utc(column: Column, data_type: T.DataType) -> Column:
    """Column of any type as timestamp; unreadable text becomes null."""
    if not isinstance(data_type, T.StringType):
        return column.try_cast("timestamp")
    compact = column.rlike(r"^\s*\d{8}\s*$")
    iso = F.when(~compact, column.try_cast("timestamp"))
    # every form holds a digit, so text without one is not tried at all
    extra = F.when(column.rlike("[0-9]"), F.coalesce(*[F.try_to_timestamp(column, F.lit(form)) for form in EXTRA_FORMATS]))
    return F.coalesce(iso, extra)


def moment(value: str | datetime) -> Column:
    """Literal for an ``as_of`` argument."""
    return F.lit(str(value)).cast("timestamp")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days from ``earlier`` to ``later``; unknown or negative counts as 0."""
    days = F.timestamp_diff("DAY", earlier, later)
    return F.greatest(F.coalesce(days, F.lit(0)), F.lit(0)).cast("int")
