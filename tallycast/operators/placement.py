"""Placing the rows of groups of very different size."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(df: DataFrame, sizes: DataFrame, by: str, key: str, places: int) -> DataFrame:
    """Repartition ``df`` so that each group lies in places of its own, as many as its size asks for.

    ``sizes`` (by, count) says how large the groups are. A group with a third of all rows gets a
    third of the ``places`` (rounded up) and any other at least one; its rows are dealt over them
    by a hash of ``key``. A task then holds one group, which bounds what partial sums per group
    take, and no place holds much more than its share. Rows of groups without a size are dropped.
    The driver sees one number per group.
    """
    counted = sorted((r[0], r["count"]) for r in sizes.select(by, "count").collect() if r[0] is not None)
    total = max(1, sum(n for _, n in counted))
    spans, first = [], 0
    for group, n in counted:
        width = max(1, ceil(n * places / total))
        spans.append((group, first, width))
        first += width
    kind = df.schema[by].dataType.simpleString()
    table = df.sparkSession.createDataFrame(spans, f"`{by}` {kind}, _first int, _width int")
    place = (F.col("_first") + F.pmod(F.xxhash64(key), F.col("_width"))).cast("int")
    return df.join(table, by).withColumn("_place", place) \
        .repartitionById(max(1, first), "_place").drop("_first", "_width", "_place")
