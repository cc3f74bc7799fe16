"""Months as half-open ranges of naive timestamps."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_bounds(period: str) -> tuple[datetime, datetime]:
    year, month = (int(x) for x in period.split("-"))
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def canonical(period: str) -> str:
    return month_bounds(period)[0].strftime("%Y-%m")


def in_month(column: Column, period: str) -> Column:
    """A range on the bare column, so that it reaches the file scan."""
    start, end = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in month_bounds(period))
    return (column >= start) & (column < end)


def in_month_of(column: Column, period: str, zone: str) -> Column:
    """The month of a time zone, as a range on a column of instants."""
    start, end = (F.lit(x.replace(tzinfo=ZoneInfo(zone))) for x in month_bounds(period))
    return (column >= start) & (column < end)


def in_zoned_month(column: Column, period: str, zone: str = "Europe/Madrid") -> Column:
    """The month of a time zone, as a range on a column of naive UTC instants; the bounds are converted, not the column."""
    start, end = (x.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ") for x in month_bounds(period))
    return (column >= F.lit(start).cast("timestamp_ntz")) & (column < F.lit(end).cast("timestamp_ntz"))
