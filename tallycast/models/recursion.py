"""Recursive multi-step forecasts: each prediction becomes the newest lag.

The whole recursion of a series is one expression over its lag array and its future
effects, so all steps run in one stage. The effects are gathered by series as narrow rows and
meet the lags once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.arrays import dot
from tallycast.functions.nulls import clamp_nonneg
from tallycast.models.design import Design
from tallycast.session import stage

# Limit of a log- or logit-scale predictor, in fits and forecasts alike.
ETA_LIMIT = 30.0


def recurse(lags: Column, future: Column, n_lags: int,
            step: Callable[[Column, Column], Column]) -> Column:
    """Predictions for every element of ``future`` as array<double>.

    ``step(window, effect)`` predicts from the newest-first window and that step's
    future element. The state is one array that grows at the front: its first
    ``n_lags`` elements are always the current lags.
    """
    grown = F.aggregate(
        future, lags.cast("array<double>"),
        lambda state, effect: F.concat(
            F.array(step(F.slice(state, 1, n_lags), effect)), state
        ),
    )
    return F.reverse(F.slice(grown, 1, F.size(future)))


def split_frame(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, days) of a test frame that repeats the lags at every step."""
    origin = frame.groupBy("id").agg(F.first("lags").alias("lags"), F.first("mean").alias("mean"))
    return origin, frame.drop("lags", "mean")


def collect_steps(origin: DataFrame, days: DataFrame, effects: dict[str, Column]) -> DataFrame:
    """One row per series: its lags and the future effects in step order (H of them).

    Only (id, step, effects) are shuffled for the steps; the lags join once per series.
    """
    narrow = days.select("id", F.struct("h", *[e.alias(n) for n, e in effects.items()]).alias("p"))
    steps = narrow.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("future"))
    return origin.join(steps, "id")


def explode_steps(df: DataFrame, predictions: Column, scaled: bool, nonneg: bool = True) -> DataFrame:
    """(id, h, yhat) from a prediction array, scaled back by the series mean.

    Every series keeps all its steps: a series whose mean is 0 is forecast 0, one without
    enough lags or without a model keeps null.
    """
    none = F.array_repeat(F.lit(None).cast("double"), F.size("future"))
    out = df.select("id", "mean", F.posexplode(F.coalesce(predictions, none)).alias("pos", "yhat"))
    yhat = F.col("yhat") * F.col("mean") if scaled else F.col("yhat")
    yhat = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(yhat) if scaled else yhat
    return out.select("id", (F.col("pos") + 1).cast("int").alias("h"),
                      (clamp_nonneg(yhat) if nonneg else yhat).alias("yhat"))


def unforecast(forecasts: DataFrame) -> DataFrame:
    """Ids whose steps have no value: too short a history, no cluster, or no fitted model."""
    return forecasts.where(F.col("yhat").isNull()).select("id").distinct()


def forecast_linear(origin: DataFrame, days: DataFrame, coefficients: DataFrame, design: Design,
                    by: str | None = None, link: str = "identity", scaled: bool = True,
                    nonneg: bool = True) -> DataFrame:
    """Recursive forecasts of a linear predictor -> (id, h, yhat).

    ``coefficients`` holds lag_beta and ext_beta per ``by`` value. They are written once, so Spark
    knows their size; the lag part joins per series, the other part per day.
    """
    if by is None:
        row = coefficients.first()
        return forecast_fixed(origin, days, row["lag_beta"], row["ext_beta"], design, link, scaled, nonneg)
    fitted = stage(coefficients.select(by, "lag_beta", "ext_beta"), "coefficients")
    return _forecast(origin.join(fitted.select(by, "lag_beta"), by, "left"),
                     days.join(fitted.select(by, "ext_beta"), by, "left"), design, link, scaled, nonneg)


def forecast_fixed(origin: DataFrame, days: DataFrame, lag_beta: list[float],
                   ext_beta: dict[str, float], design: Design, link: str = "identity",
                   scaled: bool = False, nonneg: bool = True) -> DataFrame:
    """Recursive forecasts of one global model given by its coefficients."""
    beta = F.array(*[F.lit(b) for b in lag_beta]).cast("array<double>")
    return _forecast(origin.withColumn("lag_beta", beta),
                     days.withColumn("ext_beta", _map_literal(ext_beta)), design, link, scaled, nonneg)


def _map_literal(values: dict[str, float]) -> Column:
    if not values:
        return F.create_map().cast("map<string,double>")
    names = F.array(*[F.lit(k) for k in values])
    return F.map_from_arrays(names, F.array(*[F.lit(float(v)) for v in values.values()]))


def bounded(eta: Column) -> Column:
    """The log-scale predictor within the limits that the fits use as well."""
    return F.greatest(F.least(eta, F.lit(ETA_LIMIT)), F.lit(-ETA_LIMIT))


def _inverse_link(eta: Column, link: str) -> Column:
    return F.exp(bounded(eta)) if link == "log" else eta


def _forecast(origin: DataFrame, days: DataFrame, design: Design, link: str, scaled: bool,
              nonneg: bool) -> DataFrame:
    steps = collect_steps(origin, days, {"e": design.external_effect(F.col("ext_beta"))})
    predictions = recurse(
        F.col("lags"), F.col("future"), design.n_lags,
        lambda window, f: _inverse_link(dot(window, F.col("lag_beta")) + f["e"], link),
    )
    known = F.when(F.col("lags").isNotNull() & F.col("lag_beta").isNotNull(), predictions)
    return explode_steps(steps, known, scaled, nonneg)


def forecast_zip(origin: DataFrame, days: DataFrame, model) -> DataFrame:
    """Recursive forecasts of a zero-inflated Poisson: mean (1 - pi) * lambda."""
    count_lags, count_ext = model.count_coefficients()
    zero_lags, zero_ext = model.zero_coefficients()
    effects = {
        "c": model.design.external_effect(_map_literal(count_ext)),
        "z": model.zero_design.external_effect(_map_literal(zero_ext)),
    }
    steps = collect_steps(origin, days, effects)
    b = F.array(*[F.lit(v) for v in count_lags]).cast("array<double>")
    g = F.array(*[F.lit(v) for v in zero_lags]).cast("array<double>")

    def step(window: Column, f: Column) -> Column:
        present = 1 / (1 + F.exp(bounded(dot(window, g) + f["z"])))
        return F.exp(bounded(dot(window, b) + f["c"])) * present

    predictions = recurse(F.col("lags"), F.col("future"), model.design.n_lags, step)
    return explode_steps(steps, F.when(F.col("lags").isNotNull(), predictions), scaled=False)
