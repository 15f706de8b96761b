"""Array expressions for lag windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def push_lag(lags: Column, value: Column, length: int) -> Column:
    """Put ``value`` in front of the newest-first ``lags`` and drop the oldest."""
    return F.slice(F.concat(F.array(value), lags), 1, length)


def window_before(series: Column, i: Column, length: int) -> Column:
    """The ``length`` values before 1-based position ``i``, newest first."""
    return F.reverse(F.slice(series, i - F.lit(length), length))
