"""Lag columns, lag arrays and the training matrix.

A series holds one value per period of the calendar, so collecting one series into an
array is bounded by the calendar's length, however skewed the raw rows were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.arrays import window_before
from tallycast.functions.nulls import ratio
from tallycast.operators.joins import (
    external_vars, future_days, with_daily_price, with_price,
)
from tallycast.operators.placement import deal
from tallycast.schema import KEYS


def add_lags(df: DataFrame, n: int, value: str = "sales", by: list[str] | None = None,
             period: str = "d") -> DataFrame:
    """Columns lag1..lagn; one window, meant for small ``n``."""
    w = W.partitionBy(*(by or ["id"])).orderBy(period)
    return df.withColumns({f"lag{k}": F.lag(value, k).over(w) for k in range(1, n + 1)})


def first_difference(df: DataFrame, value: str = "sales", by: list[str] | None = None,
                     period: str = "d") -> DataFrame:
    w = W.partitionBy(*(by or ["id"])).orderBy(period)
    return df.withColumn("diff", F.col(value) - F.lag(value, 1).over(w))


def cumulative_count(df: DataFrame, by: list[str] | None = None, period: str = "d") -> DataFrame:
    """Position of each row in its series, from 1."""
    w = W.partitionBy(*(by or ["id"])).orderBy(period)
    return df.withColumn("n", F.row_number().over(w))


def series_arrays(sales: DataFrame, value: str = "sales", keys: list[str] | None = None,
                  period: str = "d", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per series: its periods and values in order, and the mean.

    ``carry`` columns come along as arrays of the same length, named ``<column>s``.
    """
    keys = keys or KEYS
    point = F.struct(F.col(period).alias("d"), F.col(value).alias("y"), *carry)
    return sales.groupBy(*keys).agg(
        F.sort_array(F.collect_list(point)).alias("_points"), F.avg(value).alias("mean")
    ).select(
        *keys, F.col("_points.d").alias("ds"), F.col("_points.y").alias("ys"),
        *[F.col(f"_points.{c}").alias(f"{c}s") for c in carry], "mean",
    )


def normalize_arrays(series: DataFrame) -> DataFrame:
    """Divide each series array by its mean (null where the mean is 0)."""
    return series.withColumn("ys", F.transform("ys", lambda y: ratio(y, F.col("mean"))))


def embed_arrays(series: DataFrame, n: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Full lag windows of each series array: rows (keys, mean, d, y, lags newest first).

    ``carry`` columns are taken at the window's target period.
    """
    arrays = ["ds", "ys", *[f"{c}s" for c in carry]]
    keys = [c for c in series.columns if c not in arrays]
    window = F.transform(
        F.sequence(F.lit(n + 1), F.size("ds")),
        lambda i: F.struct(
            F.element_at("ds", i).alias("d"),
            F.element_at("ys", i).alias("y"),
            *[F.element_at(f"{c}s", i).alias(c) for c in carry],
            window_before(F.col("ys"), i, n).alias("lags"),
        ),
    )
    return series.where(F.size("ds") > n).select(*keys, F.explode(window).alias("_w")) \
        .select(*keys, "_w.*")


def embed(sales: DataFrame, n: int, value: str = "sales", keys: list[str] | None = None,
          period: str = "d") -> DataFrame:
    """Lag embedding: y and its ``n`` previous values, full windows only.

    The windows are slices of the series array, so a row costs one copy of its lags.
    """
    return embed_arrays(series_arrays(sales, value, keys, period), n).drop("mean")


def latest_lags(sales: DataFrame, n: int, value: str = "sales", keys: list[str] | None = None,
                period: str = "d") -> DataFrame:
    """Newest ``n`` values of each series, newest first, with the last period."""
    series = series_arrays(sales, value, keys, period)
    return _origin(series, n).where(F.col("lags").isNotNull()).drop("mean")


def _origin(series: DataFrame, n: int) -> DataFrame:
    """Last period and newest ``n`` values; a series with fewer has null lags and stays."""
    keys = [c for c in series.columns if c not in ("ds", "ys")]
    newest = F.slice(F.reverse("ys"), 1, n)
    return series.select(*keys, F.element_at("ds", -1).alias("origin"),
                         F.when(F.size("ds") >= n, newest).alias("lags"))


def forecast_origin(sales: DataFrame, cutoff: int, n: int, value: str = "sales",
                    keys: list[str] | None = None, period: str = "d") -> DataFrame:
    """State of the recursion at ``cutoff``: the lags that precede the first step."""
    window = sales.where(F.col(period).between(cutoff - n + 1, cutoff))
    return latest_lags(window, n, value, keys, period)


def prepare_series(sales: DataFrame, clusters: DataFrame | None = None,
                   normalized: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Series arrays, optionally with a cluster and divided by their mean.

    All-zero series have no normalised values; they are left out of training and keep
    ``mean = 0``. A series without a cluster keeps a null one.
    """
    series = series_arrays(sales, carry=carry)
    if clusters is not None:
        series = series.join(clusters.select("id", "cluster_id"), "id", "left")
    if normalized:
        series = normalize_arrays(series)
    return series


def _with_prices(rows: DataFrame, calendar: DataFrame, prices: DataFrame | None,
                 daily_price: DataFrame | None) -> tuple[DataFrame, tuple[str, ...]]:
    """Left-join the given price table onto narrow rows; the column it adds."""
    if prices is not None:
        return with_price(rows, calendar, prices).drop("wm_yr_wk"), ("sell_price",)
    if daily_price is not None:
        return with_daily_price(rows, daily_price, "left"), ("price",)
    return rows, ()


def training_matrix(sales: DataFrame, calendar: DataFrame, n: int,
                    clusters: DataFrame | None = None, prices: DataFrame | None = None,
                    normalized: bool = True, daily_price: DataFrame | None = None) -> DataFrame:
    """Pooled training rows: y, lags and the external variables of the target day.

    One shuffle by series builds arrays, windows and means together; the calendar is
    joined on the day afterwards. A price (weekly ``prices`` or ``daily_price``) is
    attached before the lags exist, so no join ever moves rows with their lag arrays.
    Windows with a missing value are dropped; a missing price stays null.
    """
    priced, carry = _with_prices(sales, calendar, prices, daily_price)
    series = prepare_series(priced, clusters, normalized, carry)
    if clusters is not None:
        # a task holds series of one cluster, a large cluster takes as many tasks as its share
        places = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        series = deal(series.where(F.col("cluster_id").isNotNull()),
                      clusters.groupBy("cluster_id").count(), "cluster_id", "id", places)
    rows = embed_arrays(series, n, carry)
    complete = F.col("y").isNotNull() & ~F.exists("lags", lambda x: x.isNull())
    return external_vars(rows.where(complete), calendar)


def future_parts(sales: DataFrame, calendar: DataFrame, n: int, horizon: int,
                 clusters: DataFrame | None = None, prices: DataFrame | None = None,
                 normalized: bool = True,
                 daily_price: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a recursion needs, apart: (origin, days).

    ``origin`` has one row per series with its newest lags (null if it has fewer) and mean;
    ``days`` one narrow row per series and future step with that day's externals. They join
    by series, so lag arrays are never copied per step.
    """
    origin = _origin(prepare_series(sales, clusters, normalized), n)
    days = future_days(origin.drop("lags", "mean"), F.col("origin"), horizon)
    priced, _ = _with_prices(days, calendar, prices, daily_price)
    return origin, external_vars(priced, calendar)


def test_frame(sales: DataFrame, calendar: DataFrame, n: int, horizon: int,
               clusters: DataFrame | None = None, prices: DataFrame | None = None,
               normalized: bool = True, daily_price: DataFrame | None = None) -> DataFrame:
    """One row per series and future step: newest lags plus that day's externals."""
    origin, days = future_parts(sales, calendar, n, horizon, clusters, prices, normalized, daily_price)
    return days.join(origin.select("id", "lags", "mean").where(F.col("lags").isNotNull()), "id")
