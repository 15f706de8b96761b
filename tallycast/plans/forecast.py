"""Forecasting routes: simple, cluster-wise, global, Poisson, boosted, intermittent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.models.boost import (
    BoostParams, fit_boosted_by_cluster, fit_boosted_poisson, forecast_boosted,
)
from tallycast.models.design import default_design
from tallycast.models.ols import (
    drop_aliased, fit_linear_regression, fit_ols, mllib_coefficients,
)
from tallycast.models.poisson import fit_poisson, fit_zip
from tallycast.models.recursion import forecast_fixed, forecast_linear, forecast_zip
from tallycast.operators.intermittent import classify_sbc, croston, route, route_union
from tallycast.operators.lags import future_parts, training_matrix
from tallycast.operators.sampling import holdout
from tallycast.session import stage

# Factor sets of the models.
POISSON_FACTORS = ("weekday_flag", "month", "snap",
                   "event_name_1", "event_name_2", "event_type_1", "event_type_2")
ZERO_FACTORS = ("weekday_flag", "snap", "event_name_1", "event_name_2")
GLOBAL_FACTORS = ("wday", "month", "snap", "day",
                  "event_name_1", "event_name_2", "event_type_1", "event_type_2")
STATIC_FACTORS = ("state_id", "cat_id")


def naive(sales: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """The last value, repeated."""
    last = sales.where(F.col("d") == cutoff)
    return last.select(
        "id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"),
        F.col("sales").alias("yhat"),
    )


def seasonal_naive(sales: DataFrame, cutoff: int, horizon: int, season: int) -> DataFrame:
    """The value one season before each step (``horizon`` up to one season)."""
    past = F.col("d").between(cutoff - season + 1, cutoff - season + horizon)
    return sales.where(past).select(
        "id", (F.col("d") - (cutoff - season)).cast("int").alias("h"), F.col("sales").alias("yhat")
    )


def mean_forecast(sales: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """The mean up to the cut-off, repeated."""
    mean = sales.where(F.col("d") <= cutoff).groupBy("id").agg(F.avg("sales").alias("yhat"))
    return mean.select("id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "yhat")


def fill_future_price(frame: DataFrame, prices: DataFrame, keys: list[str], price: str,
                      period: str) -> DataFrame:
    """A future day without a price takes the newest price of its series."""
    newest = prices.groupBy(*keys).agg(F.max_by(price, period).alias("_newest"))
    filled = F.coalesce(price, "_newest")
    return frame.join(newest, keys, "left").withColumn(price, filled).drop("_newest")


def cluster_forecast(sales: DataFrame, calendar: DataFrame, clusters: DataFrame, n_lags: int = 400,
                     horizon: int = 28, model: str = "ols",
                     params: BoostParams = BoostParams(), holdout_rows: int = 0,
                     state: str | None = None) -> DataFrame:
    """One pooled model per cluster on mean-scaled series, forecast recursively.

    ``ols`` fits all clusters in one grouped reduction; ``boost`` fits a boosted model
    per cluster, whose fit ends by the error of ``holdout_rows`` rows set aside in each cluster,
    and keeps its steps in the folder ``state`` if one is given.
    Every series keeps its steps: all-zero series are 0; short ones, and those
    without a cluster or with an unfitted one, are null (see ``recursion.unforecast``).
    """
    rows = training_matrix(sales, calendar, n_lags, clusters)
    origin, days = future_parts(sales, calendar, n_lags, horizon, clusters)
    design = default_design(calendar, n_lags)
    if model == "ols":
        fitted = fit_ols(rows, design, "cluster_id")
        return forecast_linear(origin, days, fitted, design, "cluster_id")
    models = fit_boosted_by_cluster(rows, design, "cluster_id", params, holdout_rows, state)
    return forecast_boosted(origin, days, models, scaled=True, by="cluster_id")


def global_linear_forecast(sales: DataFrame, calendar: DataFrame, prices: DataFrame | None = None,
                           n_lags: int = 56, horizon: int = 28,
                           static_factors: tuple[str, ...] = ("dept_id", "cat_id", "store_id", "state_id"),
                           price: str = "sell_price", nonneg: bool = False) -> DataFrame:
    """One pooled regression with intercept over lags, price, calendar and static keys.

    Rows without a price are left out of the fit, as an inner join would do; a future day
    without one takes the newest.
    """
    numeric = (price,) if prices is not None else ()
    rows = training_matrix(sales, calendar, n_lags, prices=prices)
    if numeric:
        rows = rows.dropna(subset=list(numeric))
    origin, days = future_parts(sales, calendar, n_lags, horizon, prices=prices)
    if numeric:
        days = fill_future_price(days, prices, ["store_id", "item_id"], price, "wm_yr_wk")
    design = default_design(
        calendar, n_lags, statics=sales, static_factors=static_factors, numeric=numeric,
        calendar_factors=GLOBAL_FACTORS, intercept=True, drop_first=True,
    )
    rows = rows.persist()
    try:
        design = drop_aliased(rows, design)
        model = fit_linear_regression(rows, design)
    finally:
        rows.unpersist()
    return forecast_fixed(origin, days, *mllib_coefficients(model, design), design,
                          scaled=True, nonneg=nonneg)


def poisson_forecast(sales: DataFrame, calendar: DataFrame, daily_price: DataFrame | None = None,
                     n_lags: int = 10, horizon: int = 28, zero_inflated: bool = False,
                     max_iter: int = 50) -> DataFrame:
    """Poisson or zero-inflated Poisson on raw sales, forecast on the response scale.

    ``daily_price`` (id, d, price) adds the price to both parts. It has a row for every day
    from launch on, sold or not; days before the launch are left out, and a future day without
    a price takes the series' newest one.
    """
    rows = training_rows(sales, calendar, daily_price, n_lags)
    origin, days = future_parts(sales, calendar, n_lags, horizon, normalized=False, daily_price=daily_price)
    numeric: tuple[str, ...] = ()
    if daily_price is not None:
        numeric = ("price",)
        days = fill_future_price(days, daily_price, ["id"], "price", "d")
    shared = dict(numeric=numeric, intercept=True, drop_first=True)
    design = default_design(calendar, n_lags, statics=sales, static_factors=STATIC_FACTORS,
                            calendar_factors=POISSON_FACTORS, **shared)
    rows = rows.persist()
    try:
        design = drop_aliased(rows, design)
        if not zero_inflated:
            model = fit_poisson(rows, design, max_iter)
            return forecast_fixed(origin, days, *mllib_coefficients(model, design), design, link="log")
        zero = default_design(calendar, n_lags, calendar_factors=ZERO_FACTORS, **shared)
        return forecast_zip(origin, days, fit_zip(rows, design, drop_aliased(rows, zero), max_iter))
    finally:
        rows.unpersist()


def boosted_forecast(sales: DataFrame, calendar: DataFrame, daily_price: DataFrame | None = None,
                     n_lags: int = 10, horizon: int = 28,
                     params: BoostParams = BoostParams(), holdout_rows: int = 0) -> DataFrame:
    """One global boosted model on raw sales, forecast recursively.

    Training days before the launch are dropped; a future day without a price keeps an
    indicator of its absence. ``holdout_rows`` sets aside that many rows, whose error ends the fit.
    """
    model = fit_global_boosting(sales, calendar, daily_price, n_lags, params, holdout_rows)
    origin, days = future_parts(sales, calendar, n_lags, horizon, normalized=False, daily_price=daily_price)
    return forecast_boosted(origin, days, model)


def training_rows(sales: DataFrame, calendar: DataFrame, daily_price: DataFrame | None,
                  n_lags: int) -> DataFrame:
    """Raw training rows of the global models, from launch on if a price is given."""
    rows = training_matrix(sales, calendar, n_lags, normalized=False, daily_price=daily_price)
    return rows if daily_price is None else rows.where(F.col("price").isNotNull())


def fit_global_boosting(sales: DataFrame, calendar: DataFrame, daily_price: DataFrame | None = None,
                        n_lags: int = 10, params: BoostParams = BoostParams(), holdout_rows: int = 0):
    """The model of ``boosted_forecast``; trained on the complement of the hold-out sample."""
    rows = training_rows(sales, calendar, daily_price, n_lags)
    design = default_design(
        calendar, n_lags, statics=sales, static_factors=STATIC_FACTORS,
        numeric=() if daily_price is None else ("price",), calendar_factors=POISSON_FACTORS,
    )
    if not holdout_rows:
        return fit_boosted_poisson(rows, design, params)
    held, train = holdout(stage(rows, "training"), holdout_rows, params.seed, ["id", "d"])
    return fit_boosted_poisson(train, design, params, validation=held)


def intermittent_forecast(sales: DataFrame, horizon: int = 56, alpha: float | str = "grid",
                          variants: tuple[str, ...] = ("croston", "sba", "sbj")) -> DataFrame:
    """All smoothing variants for the intermittent series -> (model, id, h, yhat)."""
    intermittent = route(sales, classify_sbc(sales))["sba"]
    parts = [
        croston(intermittent, horizon, alpha, v).select(F.lit(v).alias("model"), "id", "h", "yhat")
        for v in variants
    ]
    return reduce(DataFrame.unionByName, parts)


def combined_forecast(sales: DataFrame, regular: DataFrame, horizon: int = 56,
                      alpha: float | str = "grid", variant: str = "sbj") -> DataFrame:
    """Smoothing for intermittent series, a given forecast for the regular ones."""
    classes = stage(classify_sbc(sales), "classes")
    smooth = croston(route(sales, classes)["sba"], horizon, alpha, variant)
    return route_union(regular, smooth, classes)

