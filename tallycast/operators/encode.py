"""Integer codes for categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.ordering import with_position


def first_seen_codes(calendar: DataFrame, column: str, period: str = "d") -> DataFrame:
    """(column, code): 1, 2, .. in order of first appearance; blank/null is a value.

    Positions come from a range-partitioned sort of the distinct values.
    """
    firsts = calendar.groupBy(F.coalesce(F.col(column), F.lit("")).alias(column)) \
        .agg(F.min(period).alias("first_seen"))
    placed = with_position(firsts, [F.col("first_seen"), F.col(column)])
    return placed.select(column, F.col("position").cast("int").alias("code"))


def encode_first_seen(df: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its first-appearance code."""
    for c in columns:
        codes = first_seen_codes(calendar, c)
        key = F.coalesce(df[c], F.lit("")) == codes[c]
        df = df.join(codes, key, "left").drop(c).withColumnRenamed("code", c)
    return df


def encode_sorted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its code in sorted order, with the smallest code 0.

    A column with missing values keeps 0 for them and starts its values at 1; a column
    without starts at 0. Codes come from the distinct values only.
    """
    for c in columns:
        # a missing value sorts first, so it takes position 1 and with it code 0
        values = with_position(df.select(F.col(c).alias("_value")).distinct(),
                               [F.col("_value").asc_nulls_first()])
        codes = values.select("_value", (F.col("position") - 1).cast("int").alias("_code"))
        df = df.join(codes, F.col(c).eqNullSafe(F.col("_value")), "left") \
            .drop(c, "_value").withColumnRenamed("_code", c)
    return df
