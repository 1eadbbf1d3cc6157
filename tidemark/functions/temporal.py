"""Date and time expressions.

Differences count boundaries crossed, not whole elapsed units: one second past
midnight is one day after one second before it.  All of them work on
``timestamp_ntz`` without going through the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_diff(start: Column, end: Column) -> Column:
    """Midnights between the two."""
    return F.datediff(F.to_date(end), F.to_date(start))


def minute_diff(start: Column, end: Column) -> Column:
    """Minute marks between the two."""
    def of_day(ts: Column) -> Column:
        return F.hour(ts) * 60 + F.minute(ts)

    return day_diff(start, end).cast("long") * 1440 + of_day(end) - of_day(start)


def hour_floor(ts: Column) -> Column:
    """Start of the hour, as ``timestamp_ntz``."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.hour(ts)
    )


def month_floor(value: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(F.to_date(value), "month")


def date_key(value: Column) -> Column:
    """Calendar date as the integer yyyymmdd."""
    day = F.to_date(value)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def key_to_date(key: Column) -> Column:
    """Integer yyyymmdd as a date."""
    return F.to_date(key.cast("string"), "yyyyMMdd")


def month_label(day: Column) -> Column:
    """Such as ``Jan 2025``."""
    return F.date_format(day, "MMM yyyy")


def iso_weekday(value: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(F.to_date(value)) + 1


def sunday_weekday(value: Column) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(F.to_date(value)) - 1


def days_before(as_of: Column, days: int) -> Column:
    """Midnight ``days`` before the day of ``as_of``, as ``timestamp_ntz``."""
    return F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz")


def last_n_days(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on.

    The raw column is compared, so the filter reaches the file scan.
    """
    return df.where(F.col(ts) >= days_before(as_of, days))


def last_minutes(df: DataFrame, ts: str, minutes: int, as_of: Column) -> DataFrame:
    """Rows of the ``minutes`` up to ``as_of``; the raw column is compared."""
    return df.where(F.col(ts) > as_of - F.make_dt_interval(mins=F.lit(minutes)))


def parse_instant(value: Column) -> Column:
    """Text to an instant; junk gives null.

    Some feeds put a ``Z`` after an explicit offset; the offset wins.
    """
    text = F.regexp_replace(value, r"([+-]\d{2}:?\d{2})Z$", "$1")
    return F.try_to_timestamp(text)


def in_zone(ts_utc: Column, zone: str) -> Column:
    """UTC wall-clock time to wall-clock time in ``zone`` (both without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc.cast("timestamp_ntz"))


def latest(df: DataFrame, column: str) -> Column:
    """Largest value of a column, as a scalar subquery usable in any filter.

    Evaluated once per query on the cluster; nothing comes to the driver and
    no join is planned.
    """
    return df.agg(F.max(column).alias("latest")).scalar()


def earliest(df: DataFrame, column: str) -> Column:
    """Smallest value of a column, as a scalar subquery."""
    return df.agg(F.min(column).alias("earliest")).scalar()
