"""Errors of fitted models on rows set aside, and what a forecast covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holdout_rmse(held: DataFrame, predictions: DataFrame, key: tuple[str, ...] = ("id", "d"),
                 y: str = "y") -> DataFrame:
    """(model, n, missing, rmse) of stored predictions (model, key, prediction) on held rows.

    Every model is measured on the same rows; a held row that a model has no value for is counted
    as missing and leaves its error as it is, so errors are compared only where ``missing`` agrees.
    """
    truth = held.select(*key, F.col(y).cast("double").alias("_y"))
    error = F.col("_y") - F.col("prediction")
    found = predictions.select("model", *key, "prediction").join(truth, list(key)).groupBy("model").agg(
        F.count("prediction").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))
    held_rows = truth.agg(F.count("*").alias("n")).scalar()
    return found.select("model", "n", (held_rows - F.col("n")).alias("missing"), "rmse")


def coverage(sales: DataFrame, forecasts: DataFrame, n_lags: int,
             clusters: DataFrame | None = None) -> DataFrame:
    """(id, steps, values, reason) of every series in ``sales``.

    ``steps`` and ``values`` count its forecast rows and those with a value. The reason says why
    values are missing: ``not forecast``, ``no cluster``, ``short history`` (fewer than ``n_lags``
    values), ``gap in the lags`` or ``no model``; null if none is missing.
    """
    newest = F.max(F.struct("d", "sales"))
    series = sales.groupBy("id").agg(
        F.count("*").alias("history"), newest["d"].alias("last"),
        F.sort_array(F.collect_list(F.struct(F.col("d").alias("d"), F.col("sales").alias("y"))), False).alias("p"))
    series = series.withColumn("lags", F.slice("p.y", 1, n_lags)).drop("p")
    if clusters is not None:
        series = series.join(clusters.select("id", F.col("cluster_id").alias("_cluster")), "id", "left")
    done = forecasts.groupBy("id").agg(F.count("*").alias("steps"), F.count("yhat").alias("values"))
    gap = F.exists("lags", lambda y: y.isNull())
    reason = F.when(F.col("steps").isNull(), "not forecast").when(F.col("values") < F.col("steps"), (
        F.when(F.col("_cluster").isNull() if clusters is not None else F.lit(False), "no cluster")
        .when(F.col("history") < n_lags, "short history").when(gap, "gap in the lags")
        .otherwise("no model")))
    return series.join(done, "id", "left").select(
        "id", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("values", F.lit(0)).alias("values"),
        reason.alias("reason"))
