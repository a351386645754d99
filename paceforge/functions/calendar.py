"""Calendar and period expressions on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
MAX_WEEKS = 13


def week_number(d: Column) -> Column:
    """ISO week."""
    return F.weekofyear(d)


def day_of_week(d: Column) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return (F.weekday(d) >= 5).cast("int")


def date_parts(d: Column) -> dict[str, Column]:
    return {
        "year": F.year(d),
        "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "quarter": F.quarter(d),
        "year_month": year_month(d),
        "week": F.weekofyear(d),
    }


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Whole elapsed days, rounded down; not the number of midnights crossed."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(DAY_MICROS)).cast("bigint")


def week_bin(days_ago: Column, max_days: Column | None = None) -> Column:
    """Days back to a week number: 0-7 -> 1, 8-14 -> 2, ...; null beyond the last bin.

    ``max_days`` is the largest ``days_ago`` of the data and decides how many bins exist.
    """
    week = F.greatest(F.lit(1), F.ceil(days_ago / 7).cast("int"))
    cap = F.lit(MAX_WEEKS)
    if max_days is not None:
        cap = F.least(cap, F.floor(max_days / 7).cast("int") + 1)
    return F.when((days_ago >= 0) & (week <= cap), week)


def seconds_impact(minutes: Column) -> Column:
    """Minutes to whole seconds, rounded away from zero."""
    seconds = minutes * 60
    return F.when(minutes > 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("bigint")
