"""Arithmetic helpers with stated rounding and order-independent sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scaled(value: Column | str, factor: float) -> Column:
    """A measure multiplied by a constant; a factor of 1 adds no arithmetic to the plan."""
    value = as_col(value)
    return value if factor == 1 else value * F.lit(float(factor))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(as_col(numerator), as_col(denominator))


def round_half_up(value: Column | str, digits: int) -> Column:
    """``floor(x * 10^digits + 0.5) / 10^digits``: the same answer on every engine."""
    factor = F.lit(float(10**digits))
    return F.floor(as_col(value) * factor + F.lit(0.5)) / factor


def total(value: Column | str, decimals: int | None = None) -> Column:
    """Sum of a measure.

    With ``decimals`` the values are summed as whole multiples of ``10^-decimals`` in a 38-digit
    decimal, so the total does not depend on the order in which partitions are merged. Use it for
    feeds that report a fixed number of decimals; without it the sum is a plain double sum.
    """
    value = as_col(value)
    if decimals is None:
        return F.sum(value)
    factor = F.lit(float(10**decimals))
    return F.sum(F.floor(value * factor + F.lit(0.5)).cast("decimal(28,0)")).cast("double") / factor


def mean(value: Column | str, decimals: int | None = None) -> Column:
    """Average over non-null values, with the same fixed-point option as :func:`total`."""
    value = as_col(value)
    if decimals is None:
        return F.avg(value)
    return F.try_divide(total(value, decimals), F.count(value))


def count_where(condition: Column) -> Column:
    """Rows for which the condition is true; null conditions do not count."""
    return F.count(F.when(condition, F.lit(1)))
