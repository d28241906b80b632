"""Dates and times. Timestamps without zone are UTC; civil times name their zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ColumnOrName, _c

NEW_YORK = "America/New_York"


def local(ts: ColumnOrName, zone: str = NEW_YORK) -> Column:
    """The civil time in a zone of a UTC time, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts).cast("timestamp_ntz"))


def local_hour(ts: ColumnOrName, zone: str = NEW_YORK) -> Column:
    return F.hour(local(ts, zone))


def is_weekend(ts: ColumnOrName, zone: str | None = NEW_YORK) -> Column:
    return F.dayofweek(local(ts, zone) if zone else _c(ts)).isin(1, 7)


def sunday_week(ts: ColumnOrName) -> Column:
    """The date of the Sunday on or before."""
    d = F.to_date(_c(ts))
    return F.date_sub(d, F.dayofweek(d) - 1)


def year_week(d: ColumnOrName) -> Column:
    """The year and its week from 00, weeks beginning on Monday, as 2025-41."""
    week = F.floor((F.dayofyear(_c(d)) + 6 - F.weekday(_c(d))) / 7)
    return F.concat(F.date_format(_c(d), "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def elapsed(unit: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole units between two times."""
    return F.timestamp_diff(unit, _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz"))


def days_crossed(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Midnights between two civil times."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def between(ts: ColumnOrName, first: str, last: str) -> Column:
    """Inclusive on both ends, as typed literals that reach the scan."""
    return _c(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))


def formatted(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def parse_timestamp(text: ColumnOrName, pattern: str = "yyyyMMdd") -> Column:
    """A timestamp from text in a given form; null where it has another one."""
    return F.try_to_timestamp(_c(text), F.lit(pattern)).cast("timestamp_ntz")
