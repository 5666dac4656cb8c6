"""Dates, time zones and time buckets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKYO = "Asia/Tokyo"

_SECONDS = {"second": 1, "minute": 60, "hour": 3600}

# Accepted written forms of a date: the shape a text must have, and its pattern.
DATE_FORMS = [
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日"),
]


def jst(as_of: datetime) -> datetime:
    """Tokyo wall time of a UTC run time (no summer time, so a fixed shift)."""
    return as_of + timedelta(hours=9)


def month_bounds(day: datetime) -> tuple[datetime, datetime]:
    """First day of the month of ``day`` and of the month after."""
    first = datetime(day.year, day.month, 1)
    return first, add_months(first, 1)


def add_months(first: datetime, months: int) -> datetime:
    """Shift the first day of a month by whole months."""
    index = first.year * 12 + first.month - 1 + months
    return datetime(index // 12, index % 12 + 1, 1)


def to_jst(ts: Column) -> Column:
    """UTC timestamp column as Tokyo wall time."""
    return F.from_utc_timestamp(ts, TOKYO)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``."""
    if unit in _SECONDS:
        size = _SECONDS[unit]

        def tick(c: Column) -> Column:
            return F.floor(F.unix_seconds(F.date_trunc("second", c.cast("timestamp"))) / size)

        return (tick(end) - tick(start)).cast("long")
    if unit == "day":
        return F.datediff(F.to_date(end), F.to_date(start)).cast("long")
    if unit == "month":
        return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("long")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    raise ValueError(f"unknown unit {unit!r}")


def bucket_start(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned bucket of ``minutes`` that holds ``ts``."""
    size = minutes * 60
    seconds = F.floor(F.unix_seconds(F.date_trunc("second", ts.cast("timestamp"))) / size) * size
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def parse_date_any(text: Column, forms: list[tuple[str, str]] = DATE_FORMS) -> Column:
    """ISO date of a text in one of several written forms, NULL if none fits."""
    tries = [F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(fmt)))) for shape, fmt in forms]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def is_date(text: Column) -> Column:
    """True for an existing calendar day written yyyy-MM-dd."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(shaped & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))
