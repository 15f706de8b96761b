"""Wide <-> long, period selection and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(wide: DataFrame, ids: list[str], label: str, value: str) -> DataFrame:
    """Melt every non-id column; null cells stay as rows."""
    columns = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, columns, label, value)


def to_wide(long: DataFrame, keys: list[str], label: str, value: str,
            labels: list) -> DataFrame:
    """Spread ``value`` into one column per label, in the order given.

    The labels are named, so no extra job looks for the distinct values.
    """
    return long.groupBy(*keys).pivot(label, labels).agg(F.first(value))


def relabel(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename all columns by position."""
    return df.toDF(*names)


def newest_period(df: DataFrame, period: str = "d") -> Column:
    """Newest period as a scalar subquery."""
    return df.select(F.max(period)).scalar()


def last_periods(df: DataFrame, n: int, period: str = "d",
                 newest: Column | int | None = None) -> DataFrame:
    """Rows of the last ``n`` periods."""
    newest = newest_period(df, period) if newest is None else newest
    newest = F.lit(newest) if isinstance(newest, int) else newest
    return df.where(F.col(period) > newest - n)


def shift_periods(df: DataFrame, offset: int, period: str = "d") -> DataFrame:
    """Move period labels by ``offset``."""
    return df.withColumn(period, F.col(period) + offset)


def to_horizon(df: DataFrame, origin: int, period: str = "d") -> DataFrame:
    """Replace the period by the horizon step ``h = period - origin``."""
    return df.withColumn("h", (F.col(period) - origin).cast("int")).drop(period)
