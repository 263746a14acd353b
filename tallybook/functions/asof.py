"""Time bounds worked out from ``as_of`` on the driver, as literals.

Literals keep every period a half-open range on the bare column, which reaches
the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str | date | datetime) -> datetime:
    if isinstance(as_of, datetime):
        return as_of
    if isinstance(as_of, date):
        return datetime(as_of.year, as_of.month, as_of.day)
    return datetime.fromisoformat(as_of)


def day(as_of: str | date | datetime) -> date:
    return moment(as_of).date()


def date_lit(d: date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def ts_lit(t: date | datetime) -> Column:
    return F.lit(moment(t).isoformat(sep=" ")).cast("timestamp_ntz")


def month_start(d: date, shift: int = 0) -> date:
    months = d.year * 12 + d.month - 1 + shift
    return date(months // 12, months % 12 + 1, 1)


def add_months(d: date, shift: int) -> date:
    """Clamps to the month end: 31 March minus one month is 28 or 29 February."""
    first = month_start(d, shift)
    last = month_start(first, 1) - timedelta(days=1)
    return first.replace(day=min(d.day, last.day))


def on_day(ts: Column, d: date) -> Column:
    return (ts >= ts_lit(d)) & (ts < ts_lit(d + timedelta(days=1)))


def in_month(ts: Column, d: date, lit=ts_lit) -> Column:
    return (ts >= lit(month_start(d))) & (ts < lit(month_start(d, 1)))
