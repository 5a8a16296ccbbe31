"""Time arithmetic that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def bucket(ts: str, seconds: int) -> Column:
    """First second, since 1970, of the bucket that a TIMESTAMP_NTZ column lies in."""
    return F.expr(f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div {seconds * 1_000_000}) * {seconds}")


def business_days(first: Column, last: Column) -> Column:
    """Days from Monday to Friday between two dates, both included; 0 if the second is earlier."""
    days = F.datediff(last, first) + 1
    full = F.floor(days / 7) * 5
    rest = F.pmod(days, F.lit(7))
    # the days that are left over begin on the first date's weekday, 0 for Monday
    start = F.weekday(first)
    left = F.greatest(F.lit(0), F.least(rest, F.lit(5) - start)) + F.greatest(F.lit(0), rest - (F.lit(7) - start))
    return F.when(days <= 0, F.lit(0)).otherwise(full + left).cast("long")


def week_window(day: Column) -> Column:
    """(first, last): from a day to its Friday; from Saturday on, the next week's Monday to Friday."""
    weekday = F.weekday(day)
    first = F.when(weekday < 5, day).otherwise(F.date_add(day, 7 - weekday))
    return F.struct(first.alias("first"), F.date_add(first, 4 - F.weekday(first)).alias("last"))
