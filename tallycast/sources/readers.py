"""Readers for the input files: typed, long at once, keyed explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.dates import blank_to_null
from tallycast.functions.ids import period_index
from tallycast.operators.reshape import to_long
from tallycast.schema import (
    EVENT_COLUMNS, KEYS, PRICES, calendar_schema, wide_sales_schema,
)


def read_sales(spark: SparkSession, path: str, first_day: int, last_day: int,
               keys: list[str] | None = None) -> DataFrame:
    """Wide sales CSV with header -> (keys, d, sales); only the named keys are kept."""
    days = [f"d_{d}" for d in range(first_day, last_day + 1)]
    wide = spark.read.schema(wide_sales_schema(days)).csv(path, header=True)
    keys = keys or KEYS
    long = to_long(wide.select(*keys, *days), keys, "label", "sales")
    return long.select(*keys, period_index("label").alias("d"), "sales")


def read_calendar(spark: SparkSession, path: str, states: list[str]) -> DataFrame:
    """Calendar CSV; ``d`` becomes an integer and blank events become null."""
    cal = spark.read.schema(calendar_schema(states)).csv(path, header=True)
    return cal.withColumns({
        "d": period_index("d"),
        **{c: blank_to_null(c) for c in EVENT_COLUMNS},
    })


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Weekly prices CSV; an absent row means the item was not on sale."""
    return spark.read.schema(PRICES).csv(path, header=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 1-based line number across the file(s) below ``path``.

    Line order inside one file split is the order Spark reads it; the splits are put in
    order by file and offset, and only their line counts (one row per split) are summed.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("seq"),
    )
    in_split = W.partitionBy("file", "offset").orderBy("seq")
    splits = lines.groupBy("file", "offset").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("file", "offset").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "file", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    return (
        lines.withColumn("pos", F.row_number().over(in_split))
        .join(starts, ["file", "offset"])
        .select((F.col("start") + F.col("pos")).cast("int").alias("line_no"), "value")
    )


def _numbers(text: Column, separator: str) -> Column:
    return F.transform(F.split(text, separator), lambda x: F.trim(x))


def read_series_matrix(spark: SparkSession, path: str, ids: DataFrame | None = None,
                       value: str = "sales", drop_last: int = 0) -> DataFrame:
    """Headerless numeric text, one series per line -> (series_no, d, value).

    ``ids`` (series_no, id) attaches the explicit key. ``drop_last`` trims columns from
    the end. ``NA`` and blank cells become null.
    """
    cells = _numbers(F.col("value"), ",")
    kept = F.slice(cells, 1, F.size(cells) - F.lit(drop_last))
    long = numbered_lines(spark, path).select(
        F.col("line_no").alias("series_no"), F.posexplode(kept).alias("pos", "cell")
    ).select(
        "series_no",
        (F.col("pos") + 1).alias("d"),
        F.when(~F.col("cell").isin("", "NA", "NaN"), F.col("cell")).cast("double").alias(value),
    )
    return long if ids is None else long.join(ids, "series_no")


def read_price_matrix(spark: SparkSession, path: str, ids: DataFrame,
                      drop_last: int = 0) -> DataFrame:
    """Headerless series x day prices -> (id, d, price)."""
    prices = read_series_matrix(spark, path, ids, value="price", drop_last=drop_last)
    return prices.select("id", "d", "price")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Line k lists the 0-based series numbers of cluster k -> (cluster_id, series_no)."""
    members = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return numbered_lines(spark, path).select(
        F.col("line_no").alias("cluster_id"), F.explode(members).alias("member")
    ).select("cluster_id", (F.col("member").cast("int") + 1).alias("series_no"))


def read_forecasts(spark: SparkSession, path: str, horizon: int) -> DataFrame:
    """Wide forecast CSV ``id,F1..FH`` -> (id, h, yhat)."""
    labels = [f"F{h}" for h in range(1, horizon + 1)]
    ddl = ", ".join(["id string", *[f"{c} double" for c in labels]])
    long = to_long(spark.read.schema(ddl).csv(path, header=True), ["id"], "label", "yhat")
    return long.select("id", period_index("label").alias("h"), "yhat")


def load_score_inputs(spark: SparkSession, root: str, period: str) -> dict[str, DataFrame]:
    """Weights, hold-out actuals and training hierarchy of one period."""
    return {
        name: spark.read.parquet(f"{root}/{name}").where(F.col("period") == period)
        for name in ("weights", "actual", "training_nodes")
    }
