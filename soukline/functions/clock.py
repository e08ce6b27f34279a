"""Date arithmetic. The four day differences are deliberately separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def elapsed_micros(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def whole_days(later: Column, earlier: Column) -> Column:
    """Day field of the interval: truncates toward zero."""
    return F.extract(F.lit("DAY"), later - earlier).cast("int")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days rounded down, so -36 hours is -2."""
    return F.floor(elapsed_micros(later, earlier) / F.lit(MICROS_PER_DAY)).cast("int")


def fractional_days(later: Column, earlier: Column) -> Column:
    return elapsed_micros(later, earlier).cast("double") / F.lit(float(MICROS_PER_DAY))


def calendar_days(later: Column, earlier: Column) -> Column:
    """Number of midnights crossed."""
    return F.datediff(later, earlier)


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def months_apart(later: Column, earlier: Column) -> Column:
    return (month_number(later) - month_number(earlier)).cast("int")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def sunday_zero(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1).cast("int")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))
