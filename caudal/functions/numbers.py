"""Safe numbers and row-wise combinations of a handful of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM_SHARE = 0.2


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null instead of failing or an infinity."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def finite(value: Column) -> Column:
    """Null for NaN and for both infinities."""
    odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~odd, value)


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, with a negative zero turned into zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + x)


def row_mean(columns: list[Column]) -> Column:
    total = columns[0].cast("double")
    for column in columns[1:]:
        total = total + column
    return total / F.lit(float(len(columns)))


def sorted_median(values: Column) -> Column:
    """Median of an already sorted, non-empty array; null for an empty one."""
    size = F.size(values)
    low, high = F.floor((size - 1) / 2).cast("int"), F.floor(size / 2).cast("int")
    return F.when(size > 0, (F.get(values, low) + F.get(values, high)) / 2.0)


def row_median(columns: list[Column]) -> Column:
    return sorted_median(F.array_sort(F.array(*columns)))


def row_trimmed_mean(columns: list[Column], share: float = TRIM_SHARE) -> Column:
    """Mean after dropping the `int(share * n)` lowest and highest of the columns."""
    cut = int(share * len(columns))
    kept = len(columns) - 2 * cut
    return _sum(F.slice(F.array_sort(F.array(*columns)), cut + 1, kept)) / F.lit(float(kept))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its inputs, so any partitioning gives the same draws."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))
