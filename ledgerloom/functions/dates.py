"""Calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def local_date(ts: Column, zone: str) -> Column:
    """The day of an instant (UTC session) in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def epoch(ts: Column, unit: str = "MICROSECOND") -> Column:
    """Units since 1970-01-01 of a time without zone, or of one in the session's zone."""
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def text(c: Column) -> Column:
    """A date as yyyy-MM-dd."""
    return F.date_format(c, "yyyy-MM-dd")
