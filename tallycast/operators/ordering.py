"""Sorted output and explicit row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.ids import CATEGORY_ORDER, STAGES, parse_id, rank_in
from tallycast.session import cut_lineage

# monotonically_increasing_id keeps the partition number above these bits
_ROW_BITS = 33


def canonical_keys(id_col: str = "id") -> list[Column]:
    """Sort keys of the output file: stage, state, store, category, item."""
    parts = parse_id(id_col)
    return [
        rank_in(parts["stage"], STAGES), parts["state_id"], parts["store_id"],
        rank_in(parts["cat_id"], CATEGORY_ORDER), parts["item_id"],
    ]


def canonical_order(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Range-partitioned sort in output order; meant for the sink."""
    return df.orderBy(*canonical_keys(id_col))


def with_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """Row position 1..n in ``order``, without passing the table through one task.

    The range-partitioned sort is written once; a row's position is its place in its
    partition plus the rows of earlier partitions (one count per partition).
    """
    numbered = cut_lineage(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _ROW_BITS)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = numbered.groupBy(part.alias("_part")).count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    place = F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    return numbered.withColumn("_part", part).join(starts, "_part") \
        .withColumn("position", F.col("_start") + place + 1).drop("_row", "_part", "_start")
