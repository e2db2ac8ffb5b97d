"""Returns, dispersion and strength over ordered closes; number texts for files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def change(now: Column, before: Column) -> Column:
    """(now - before) / before; null where before is zero."""
    return F.try_divide(now - before, before)


def growth(now: Column, before: Column) -> Column:
    """now / before - 1; null where before is zero."""
    return F.try_divide(now, before) - 1


def strength_index(gain: Column, loss: Column) -> Column:
    """Relative strength from mean gain and mean loss: 100 without losses, 50 without any move."""
    return F.when(loss > 0, 100 - F.try_divide(F.lit(100.0), 1 + gain / loss)).when(gain > 0, 100.0).when(gain.isNotNull(), 50.0)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def array_std(values: Column) -> Column:
    """Population standard deviation of an array."""
    mean = array_mean(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values))


def median_of_even(values: Column, n: int) -> Column:
    """Median of an array of an even number of values."""
    ordered = F.array_sort(values)
    return (F.element_at(ordered, n // 2) + F.element_at(ordered, n // 2 + 1)) / 2


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def number_text(pattern: str):
    """A function from doubles to texts in a printf pattern with round-half-even digits; null gives "".

    Only for the last step before a text file: it leaves the JVM.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: "" if pd.isna(v) else pattern % v)

    return text
