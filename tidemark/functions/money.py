"""Money is a count of paise in a long. Quotients are rounded half up (away from zero), as exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(a, b) -> Column:
    """Integer quotient towards zero."""
    return F.call_function("div", a, b)


def half_up(num: Column, den: Column) -> Column:
    """num / den rounded half away from zero; den is positive. Null and zero denominators give null."""
    size = whole(2 * F.abs(num) + den, 2 * den)
    return F.when(den > 0, F.when(num < 0, -size).otherwise(size))


def mean(total: Column, n: Column) -> Column:
    return half_up(total, n)


def percent4(num: Column, den: Column) -> Column:
    """100 * num / den with four decimals, as a double."""
    return half_up(num * 1_000_000, den) / F.lit(10_000.0)


def percent2(num: Column, den: Column) -> Column:
    return half_up(num * 10_000, den) / F.lit(100.0)
