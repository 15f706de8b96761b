"""From sales, prices and forecasts to the weighted scaled error."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.filters import before_date, between_dates, last_n, mask_off_sale
from tallycast.operators.hierarchy import rollup12
from tallycast.operators.reshape import shift_periods, to_horizon
from tallycast.operators.scoring import (
    mse, node_scores, scale, score_pairs, scored_nodes, series_revenue, weights12, wrmsse,
)
from tallycast.schema import KEYS
from tallycast.session import discard, exists, scratch_path


def train_hierarchy(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Training nodes with sales missing where the item was not on sale yet.

    Upper levels skip missing sales; the bottom level keeps them missing.
    """
    masked = mask_off_sale(sales, calendar, prices)
    cells = masked.select(*KEYS, "d", F.col("sales").alias("value"))
    return rollup12(cells, "value", "lenient", "strict")


def revenue_weights(sales: DataFrame, calendar: DataFrame, prices: DataFrame, cutoff: int,
                    n: int = 28, rule: str = "strict") -> DataFrame:
    """Node weights from the revenue of the last ``n`` periods."""
    return weights12(series_revenue(sales, calendar, prices, cutoff, n, rule))


def make_holdouts(sales: DataFrame, calendar: DataFrame, cutoff: int, n: int = 28,
                  window: tuple[str, str] | None = None,
                  relabel_from: int | None = None) -> dict[str, DataFrame]:
    """Hold-out tables of one period.

    Without ``window`` the test rows are the ``n`` periods ending at ``cutoff`` and the
    training rows come before them. With a date window the test rows lie inside it (and
    may be relabelled to start at ``relabel_from``), the training rows before it.
    """
    if window is None:
        return {
            "test": last_n(sales, cutoff, n),
            "train": sales.where(F.col("d") <= cutoff - n),
        }
    first, last = window
    test = between_dates(sales, calendar, first, last)
    if relabel_from is not None:
        start = calendar.where(F.col("date") == F.lit(first).cast("date")).select("d").first()[0]
        test = shift_periods(test, relabel_from - start)
    return {"test": test, "train": before_date(sales, calendar, first)}


def actual_horizon(test: DataFrame, origin: int) -> DataFrame:
    """Hold-out rows as (keys, h, sales)."""
    return to_horizon(test, origin).select(*KEYS, "h", "sales")


def score_forecasts(forecasts: DataFrame, sales: DataFrame, calendar: DataFrame,
                    prices: DataFrame, cutoff: int, horizon: int = 28,
                    revenue_rule: str = "strict") -> DataFrame:
    """Node scores of forecasts made at ``cutoff`` for the ``horizon`` periods after it."""
    train = sales.where(F.col("d") <= cutoff)
    test = sales.where(F.col("d").between(cutoff + 1, cutoff + horizon))
    return node_scores(
        forecasts,
        actual_horizon(test, cutoff),
        train_hierarchy(train, calendar, prices),
        revenue_weights(train, calendar, prices, cutoff, horizon, revenue_rule),
    )


def final_score(forecasts: DataFrame, sales: DataFrame, calendar: DataFrame, prices: DataFrame,
                cutoff: int, horizon: int = 28, revenue_rule: str = "strict") -> DataFrame:
    """The one-row WRMSSE."""
    return wrmsse(score_forecasts(forecasts, sales, calendar, prices, cutoff, horizon, revenue_rule))


@dataclass(frozen=True)
class ScoreInputs:
    """What a score needs besides the forecasts: node weights, node scales, actual sales."""

    weights: DataFrame
    scales: DataFrame
    actual: DataFrame

    def score(self, forecasts: DataFrame) -> DataFrame:
        """Node scores as by ``score_forecasts``."""
        return scored_nodes(self.scales, mse(score_pairs(forecasts, self.actual)), self.weights)


def stored_inputs(sales: DataFrame, calendar: DataFrame, prices: DataFrame, cutoff: int,
                  horizon: int, revenue_rule: str, root: str, source: str) -> ScoreInputs:
    """The score inputs of one hold-out, computed at the first call and read back after it.

    They are stored below ``root`` under a digest of the arguments and of ``source``, which names
    the state of the data (see ``session.fingerprint``), so inputs of other data or another
    cut-off are never mixed up. The dense panel is written once for the branches that read it.
    """
    spark = sales.sparkSession
    named = json.dumps([cutoff, horizon, revenue_rule, source])
    place = f"{root}/{hashlib.sha256(named.encode()).hexdigest()[:32]}"
    names = ("weights", "scales", "actual")
    if not all(exists(spark, f"{place}/{n}/_SUCCESS") for n in names):
        panel_path = scratch_path(spark, "panel")
        sales.where(F.col("d") <= cutoff + horizon).write.parquet(panel_path)
        panel = spark.read.parquet(panel_path)
        train = panel.where(F.col("d") <= cutoff)
        made = {
            "weights": revenue_weights(train, calendar, prices, cutoff, horizon, revenue_rule),
            "scales": scale(train_hierarchy(train, calendar, prices)),
            "actual": actual_horizon(panel.where(F.col("d") > cutoff), cutoff),
        }
        for name, table in made.items():
            table.write.mode("overwrite").parquet(f"{place}/{name}")
        discard(spark, panel_path)
    return ScoreInputs(*[spark.read.parquet(f"{place}/{n}") for n in names])
