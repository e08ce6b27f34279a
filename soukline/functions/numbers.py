"""Money, ratios and rounding.

Money is DECIMAL in relations and whole cents (BIGINT) inside item-level sums,
where a DECIMAL accumulator costs several times the CPU. Both are exact. A mean
is the exact sum divided once as DOUBLE, so it does not depend on the order in
which tasks finish.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE_MONEY = "decimal(28,2)"


def to_cents(value: Column) -> Column:
    return (value * 100).cast("bigint")


def from_cents(cents: Column) -> Column:
    """Exact DECIMAL amount."""
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(WIDE_MONEY)


def amount(cents: Column) -> Column:
    """DOUBLE amount, for results."""
    return cents.cast("double") / F.lit(100.0)


def money(value: Column) -> Column:
    return value.cast(MONEY)


def rounded(value: Column, digits: int = 2) -> Column:
    """Half away from zero on DOUBLE, spelled out so every engine agrees."""
    scale = float(10**digits)
    x = value.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """DOUBLE quotient, null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def divide_or(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(default))


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def bounded(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps nulls."""
    out = value
    if low is not None:
        out = F.when(value.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(value.isNotNull(), F.least(out, F.lit(high)))
    return out


def surrogate_key(value: Column) -> Column:
    """First 15 hex digits of md5 as BIGINT: the same number in any engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def fingerprint(value: Column) -> Column:
    """64-bit Spark-side key, cheaper than md5 when no other engine reads it."""
    return F.xxhash64(value)


def right_closed_band(value: Column, edges: list, labels: list[str]) -> Column:
    """label[i] for edges[i] < value <= edges[i+1]; an edge of None is open."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value > low)
        if high is not None:
            inside = inside & (value <= high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out
