"""Attaching prices, calendar and hierarchy to series rows.

No join is hinted here: a calendar read from a file or built from a range has a size
Spark knows, so it is broadcast under Spark's own threshold and shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.dates import (
    day_of_month, fill_event, snap_for_state, weekday_flag,
)
from tallycast.schema import EVENT_COLUMNS


def daily_prices(calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Every day with each price of its week (days without prices keep one null row)."""
    return calendar.select("date", "wm_yr_wk", "d").join(prices, "wm_yr_wk", "left")


def with_price(sales: DataFrame, calendar: DataFrame, prices: DataFrame,
               how: str = "left") -> DataFrame:
    """Sales with the price of (store, item, week of the day).

    The day is mapped to its week first, so the weekly table is joined as it is instead
    of being copied once per day.
    """
    keyed = sales.join(calendar.select("d", "wm_yr_wk"), "d", "left")
    return keyed.join(prices, ["store_id", "item_id", "wm_yr_wk"], how)


def with_daily_price(rows: DataFrame, prices: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the price of (id, day); an inner join drops days without a price."""
    return rows.join(prices.select("id", "d", "price"), ["id", "d"], how)


def with_calendar(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    return sales.join(calendar, "d")


def with_hierarchy(forecasts: DataFrame, keys: DataFrame) -> DataFrame:
    """Hierarchy keys on the left: a series without forecast keeps a null row."""
    return keys.join(forecasts, "id", "left")


def snap_states(calendar: DataFrame) -> list[str]:
    return [c.removeprefix("snap_") for c in calendar.columns if c.startswith("snap_")]


def calendar_features(calendar: DataFrame) -> DataFrame:
    """One row per day: the external variables that do not depend on the series."""
    return calendar.select(
        "d", "wm_yr_wk", "month", "wday",
        day_of_month("date").alias("day"),
        weekday_flag("weekday").alias("weekday_flag"),
        *[fill_event(c).alias(c) for c in EVENT_COLUMNS],
        *[F.col(f"`{c}`") for c in calendar.columns if c.startswith("snap_")],
    )


def external_vars(rows: DataFrame, calendar: DataFrame,
                  prices: DataFrame | None = None) -> DataFrame:
    """Add month, snap of the row's state, weekday flag, wday, day and events by ``d``.

    With weekly ``prices`` the sell price of the day is added too (left join).
    """
    states = snap_states(calendar)
    joined = rows.join(calendar_features(calendar), "d", "left")
    joined = joined.withColumn("snap", snap_for_state("state_id", states)) \
        .drop(*[f"snap_{s}" for s in states])
    if prices is not None:
        joined = joined.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    return joined.drop("wm_yr_wk")


def future_days(series: DataFrame, origin: int | Column, horizon: int) -> DataFrame:
    """Each series once per future day: (.., h, d) for h = 1..horizon.

    Built by generating the steps from the series row, so no table is multiplied with
    another and the partitioning by series is kept.
    """
    origin = F.lit(origin) if isinstance(origin, int) else origin
    steps = series.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.withColumn("d", (origin + F.col("h")).cast("int"))


def future_frame(series: DataFrame, calendar: DataFrame, origin: int | Column, horizon: int,
                 prices: DataFrame | None = None) -> DataFrame:
    """External variables of every series for each future day, prices refreshed by week."""
    return external_vars(future_days(series, origin, horizon), calendar, prices)
