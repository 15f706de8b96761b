"""Output tables: id, F1..FH for the validation and the evaluation stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.ids import STAGES, horizon_label, make_id, rank_in, restage
from tallycast.operators.reshape import last_periods, newest_period, to_wide


def horizon_labels(horizon: int = 28) -> list[str]:
    return [f"F{h}" for h in range(1, horizon + 1)]


def output_wide(long: DataFrame, horizon: int = 28) -> DataFrame:
    """(id, h, yhat) -> id, F1..FH."""
    labelled = long.withColumn("label", horizon_label("h"))
    return to_wide(labelled, ["id"], "label", "yhat", horizon_labels(horizon))


def assemble_output(sales: DataFrame, forecasts: DataFrame, horizon: int = 28) -> DataFrame:
    """Last ``horizon`` actuals as validation, forecasts as evaluation -> (id, h, yhat)."""
    newest = newest_period(sales)
    validation = last_periods(sales, horizon).select(
        make_id("item_id", "store_id", "validation").alias("id"),
        (F.col("d") - (newest - horizon)).cast("int").alias("h"), F.col("sales").alias("yhat"),
    )
    names = sales.groupBy("id").agg(
        F.first(make_id("item_id", "store_id", "evaluation")).alias("_out")
    )
    evaluation = forecasts.join(names, "id").select(F.col("_out").alias("id"), "h", "yhat")
    return validation.unionByName(evaluation)


def assemble_output_56(forecasts: DataFrame, names: DataFrame, horizon: int = 28) -> DataFrame:
    """Forecasts of two horizons: the first half is validation, the second evaluation.

    ``names`` holds id, item_id and store_id, one row per series.
    """
    first = F.col("h") <= horizon
    rows = forecasts.join(names.select("id", "item_id", "store_id"), "id")
    return rows.select(
        F.when(first, make_id("item_id", "store_id", "validation"))
        .otherwise(make_id("item_id", "store_id", "evaluation")).alias("id"),
        F.when(first, F.col("h")).otherwise(F.col("h") - horizon).cast("int").alias("h"),
        "yhat",
    )


def replicate_stage(rows: DataFrame) -> DataFrame:
    """The validation rows again under the evaluation stage."""
    return rows.unionByName(rows.withColumn("id", restage("id")))


def assemble_output_copy(forecasts: DataFrame, horizon: int = 28) -> DataFrame:
    """Wide output with missing steps 0, sorted by id within each stage copy."""
    both = replicate_stage(output_wide(forecasts, horizon).fillna(0.0))
    return both.orderBy(rank_in(F.element_at(F.split("id", "_"), -1), STAGES), "id")
