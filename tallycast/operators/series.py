"""Per-series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.nulls import ratio


def series_mean(sales: DataFrame, value: str = "sales", by: list[str] | None = None) -> DataFrame:
    return sales.groupBy(*(by or ["id"])).agg(F.avg(value).alias("mean"))


def row_count(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or ["item_id", "store_id"])).agg(F.count(F.lit(1)).alias("n"))


def latest_row(df: DataFrame, by: list[str] | None = None, period: str = "d") -> DataFrame:
    """Newest row of each group, by a partial max of (period, row); no sort."""
    by = by or ["item_id", "store_id"]
    rest = [c for c in df.columns if c not in by]
    newest = F.max_by(F.struct(*rest), period).alias("_row")
    return df.groupBy(*by).agg(newest).select(*by, "_row.*")


def ensemble_mean(forecasts: list[DataFrame]) -> DataFrame:
    """Mean of several models' (id, h, yhat); a step missing in one model is missing."""
    stacked = forecasts[0].select("id", "h", "yhat")
    for fc in forecasts[1:]:
        stacked = stacked.unionByName(fc.select("id", "h", "yhat"))
    complete = F.count("yhat") == len(forecasts)
    return stacked.groupBy("id", "h").agg(F.when(complete, F.avg("yhat")).alias("yhat"))


def demand_stats(sales: DataFrame, value: str = "sales", period: str = "d",
                 by: list[str] | None = None) -> DataFrame:
    """Mean inter-demand interval and squared variation of the demand sizes.

    Intervals are counted from the series start, so they add up to the position of the
    last demand and no ordering is needed: one partially aggregated pass.
    """
    size = F.when(F.col(value) > 0, F.col(value))
    last_demand = F.max(F.when(F.col(value) > 0, F.col(period)))
    span = last_demand - F.min(period) + 1
    # whole-number sums are exact, so the squared variation does not depend on their order
    n, total, squares = F.count(size), F.sum(size), F.sum(size * size)
    variance = F.try_divide(squares - total * total / n, (n - 1).cast("double"))
    return sales.groupBy(*(by or ["id"])).agg(
        F.count(size).alias("n_demands"),
        ratio(span, F.count(size)).alias("adi"),
        ratio(variance, (total / n) * (total / n)).alias("cv2"),
    )


def normalize(sales: DataFrame, value: str = "sales", by: list[str] | None = None) -> DataFrame:
    """Divide each series by its own mean, kept in ``mean``; an all-zero series is null."""
    from pyspark.sql import Window as W

    mean = F.avg(value).over(W.partitionBy(*(by or ["id"])))
    return sales.withColumn("mean", mean) \
        .withColumn(value, ratio(F.col(value), F.col("mean")))


def denormalize(forecasts: DataFrame, means: DataFrame, value: str = "yhat") -> DataFrame:
    """Multiply forecasts by their series' mean, matched by id."""
    return forecasts.join(means.select("id", "mean"), "id", "left") \
        .withColumn(value, F.col(value) * F.col("mean")).drop("mean")
