"""Row filters: periods, dates, availability, completeness, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.ids import parse_id
from tallycast.operators.reshape import newest_period


def last_n(df: DataFrame, cutoff: int, n: int = 28, period: str = "d") -> DataFrame:
    """The ``n`` periods that end at ``cutoff``."""
    return df.where(F.col(period).between(cutoff - n + 1, cutoff))


def between_dates(df: DataFrame, calendar: DataFrame, first: str, last: str) -> DataFrame:
    """Rows whose day falls between two dates of the calendar, both included."""
    wanted = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.join(calendar.where(wanted).select("d"), "d", "left_semi")


def before_date(df: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """Rows whose day lies before a date: the training window of a hold-out."""
    days = calendar.where(F.col("date") < F.lit(date).cast("date")).select("d")
    return df.join(days, "d", "left_semi")


def mask_unavailable(sales: DataFrame, price: str = "sell_price") -> DataFrame:
    """Sales become null where no price exists, i.e. the item was not on sale."""
    return sales.withColumn("sales", F.when(F.col(price).isNotNull(), F.col("sales")))


def on_sale(prices: DataFrame, week: str = "wm_yr_wk") -> DataFrame:
    """(store_id, item_id, first_week, last_week): when a pair was on sale, one row each."""
    return prices.where(F.col("sell_price").isNotNull()).groupBy("store_id", "item_id").agg(
        F.min(week).alias("first_week"), F.max(week).alias("last_week"))


def mask_off_sale(sales: DataFrame, calendar: DataFrame, prices: DataFrame,
                  withdrawn: bool = False) -> DataFrame:
    """Sales become null outside the interval in which their item was on sale.

    The interval begins with the first priced week; with ``withdrawn`` it ends with the last one,
    else it stays open. Between them a week without a price row is on sale, so its zeros stay. An
    item that never had a price is null throughout. The intervals hold one row per (store, item)
    and are joined by key and range, so no row of ``sales`` is multiplied.
    """
    spans = on_sale(prices).select(
        F.col("store_id").alias("_store"), F.col("item_id").alias("_item"), "first_week", "last_week")
    weeks = sales.join(calendar.select("d", F.col("wm_yr_wk").alias("_week")), "d", "left")
    inside = (F.col("store_id") == F.col("_store")) & (F.col("item_id") == F.col("_item")) \
        & (F.col("_week") >= F.col("first_week"))
    if withdrawn:
        inside = inside & (F.col("_week") <= F.col("last_week"))
    return weeks.join(spans, inside, "left") \
        .withColumn("sales", F.when(F.col("first_week").isNotNull(), F.col("sales"))) \
        .drop("_week", "_store", "_item", "first_week", "last_week")


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with any null in ``columns``, arrays with a null element included."""
    wanted = columns or df.columns
    arrays = [c for c, t in df.dtypes if c in wanted and t.startswith("array")]
    complete = df.dropna(subset=wanted)
    for c in arrays:
        complete = complete.where(~F.exists(c, lambda x: x.isNull()))
    return complete


def split_calendar(calendar: DataFrame, h: int) -> dict[str, DataFrame]:
    """Calendar parts from the end: ``h`` unused days, ``h`` test days, the rest training."""
    newest = newest_period(calendar)
    d = F.col("d")
    return {
        "train": calendar.where(d <= newest - 2 * h),
        "test": calendar.where((d > newest - 2 * h) & (d <= newest - h)),
        "unused": calendar.where(d > newest - h),
    }


def first_stage(df: DataFrame, stage: str = "validation", id_col: str = "id") -> DataFrame:
    """Rows of one stage, chosen by the id and not by row position."""
    return df.where(parse_id(id_col)["stage"] == stage)


def at_period(df: DataFrame, k: int, period: str = "d") -> DataFrame:
    return df.where(F.col(period) == k)
