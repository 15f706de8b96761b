"""Scale, errors, revenue weights and the weighted scaled error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.ids import strip_stage
from tallycast.functions.nulls import lenient_sum, ratio, strict_avg, strict_sum
from tallycast.operators.filters import last_n
from tallycast.operators.hierarchy import Measure, rollup12
from tallycast.operators.joins import with_price
from tallycast.schema import KEYS, N_LEVELS

NODE = ["level_id", "name"]


def revenue(sales: Column | str = "sales", price: Column | str = "sell_price") -> Column:
    sales = F.col(sales) if isinstance(sales, str) else sales
    price = F.col(price) if isinstance(price, str) else price
    return sales * price


def series_revenue(sales: DataFrame, calendar: DataFrame, prices: DataFrame, cutoff: int,
                   n: int = 28, rule: str = "strict") -> DataFrame:
    """Revenue of each series over the ``n`` periods ending at ``cutoff``.

    The window is cut before the price join, so both scans read only its periods.
    """
    priced = with_price(last_n(sales, cutoff, n), last_n(calendar, cutoff, n), prices)
    total = {"strict": strict_sum, "lenient": lenient_sum}[rule]
    return priced.withColumn("_rev", revenue()).groupBy(*KEYS).agg(total("_rev").alias("revenue"))


def grand_total(df: DataFrame, column: str = "revenue", rule: str = "strict") -> DataFrame:
    total = {"strict": strict_sum, "lenient": lenient_sum}[rule]
    return df.agg(total(column).alias("total"))


def weights12(rev: DataFrame) -> DataFrame:
    """Node weights: share of the total revenue over the number of levels.

    The Total node always weighs 1/12, whatever its revenue.
    """
    nodes = rollup12(rev, "revenue", "strict", period=None)
    total = grand_total(rev).scalar()
    share = F.when(F.col("level_id") == 1, F.lit(1.0)).otherwise(ratio(F.col("revenue"), total))
    return nodes.select(*NODE, (share / N_LEVELS).alias("weight"))


def scale(nodes: DataFrame, value: str = "value", period: str = "d",
          by: list[str] | None = None) -> DataFrame:
    """Mean squared first difference of each node over its non-missing values.

    Missing values go first, so a difference bridges a gap, and the divisor is the number
    of kept values minus one. A node with fewer than two values has a null scale.
    """
    by = by or NODE
    # last(ignorenulls) looks back over missing values, so a node whose values are all
    # missing keeps its row (with a null scale); the aggregate reuses the node shuffle
    before = W.partitionBy(*by).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    step = F.col(value) - F.last(value, ignorenulls=True).over(before)
    stepped = nodes.withColumn("_step", step)
    return stepped.groupBy(*by).agg(
        ratio(F.sum(F.col("_step") * F.col("_step")), F.count(value) - 1).alias("scale")
    )


def mse(pairs: DataFrame, actual: str = "sales", forecast: str = "yhat",
        by: list[str] | None = None) -> DataFrame:
    """Mean squared error over the horizon; one missing pair makes it missing."""
    err = F.col(actual) - F.col(forecast)
    return pairs.withColumn("_se", err * err).groupBy(*(by or NODE)) \
        .agg(strict_avg("_se").alias("mse"))


def rmsse(mse_col: Column | str = "mse", scale_col: Column | str = "scale") -> Column:
    return F.sqrt(ratio(mse_col, scale_col))


def rmse(rows: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    err = F.col(y) - F.col(prediction)
    return rows.agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def score_pairs(forecasts: DataFrame, actual: DataFrame) -> DataFrame:
    """Actual and forecast on every node and step, from one roll-up of both.

    ``actual``: keys, h, sales. ``forecasts``: id, h, yhat. A missing forecast makes its
    nodes missing; missing sales are skipped above the bottom level.
    """
    keyed = actual.withColumn("id", strip_stage("id"))
    fc = forecasts.select(strip_stage("id").alias("id"), "h", "yhat")
    cells = keyed.join(fc, ["id", "h"], "left")
    measures = [Measure("sales", "lenient", "strict"), Measure("yhat", "strict")]
    return rollup12(cells, measures, period="h")


def node_scores(forecasts: DataFrame, actual: DataFrame, training_nodes: DataFrame,
                weights: DataFrame) -> DataFrame:
    """Per node: scale, MSE, RMSSE, weight and the weighted term."""
    train = training_nodes.withColumn("name", strip_stage("name"))
    return scored_nodes(scale(train), mse(score_pairs(forecasts, actual)), weights)


def scored_nodes(scales: DataFrame, errors: DataFrame, weights: DataFrame) -> DataFrame:
    """The same from the scale, error and weight of each node."""
    scales = scales.withColumn("name", strip_stage("name"))
    named = weights.select("level_id", strip_stage("name").alias("name"), "weight")
    scored = scales.join(errors, NODE, "left").withColumn("rmsse", rmsse())
    return scored.join(named, NODE, "left") \
        .withColumn("wrmsse", F.col("rmsse") * F.col("weight"))


def wrmsse(scores: DataFrame) -> DataFrame:
    """The final score: missing as soon as one node's term is missing."""
    return scores.agg(
        strict_sum("wrmsse").alias("wrmsse"),
        F.count_if(F.col("wrmsse").isNull()).alias("unscored_nodes"),
    )


def wrmsse_by_level(scores: DataFrame) -> DataFrame:
    """Each level's own score (its weights rescaled to sum to one)."""
    return scores.groupBy("level_id").agg((strict_sum("wrmsse") * N_LEVELS).alias("wrmsse"))


def unscored(scores: DataFrame) -> DataFrame:
    """Nodes that have no finite term, e.g. constant ones."""
    return scores.where(F.col("wrmsse").isNull()).select(*NODE, "scale", "mse", "weight")
