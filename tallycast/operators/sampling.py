"""Seeded hold-out sample of an exact size, and its complement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.functions.ids import node_name
from tallycast.session import stage

# Hex digits by which a rank prefix grows, and the rows of a prefix that may be ordered at once.
_STEP_DIGITS = 4
_HASH_DIGITS = 32
_ORDERED_ROWS = 100_000


def with_sample_rank(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """A reproducible random text rank per row, unique as far as the rows differ."""
    text = node_name(*key)
    rest = F.lpad(F.hex(F.xxhash64(*[F.col(c) for c in df.columns])), 16, "0")
    rank = F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), text)), F.lit("|"), text, F.lit("|"), rest)
    return df.withColumn("_rank", rank)


def _boundary(ranked: DataFrame, n: int) -> tuple[str, int] | None:
    """The n-th smallest rank, and how many rows of that rank belong to the first n."""
    inside, digits, seen = ranked, 0, 0
    while True:
        digits += _STEP_DIGITS
        prefix = F.substring("_rank", 1, digits)
        counts = inside.groupBy(prefix.alias("prefix")).count().orderBy("prefix")
        held, cut = 0, None
        for row in counts.toLocalIterator():  # at most 16 ** 4 prefixes below the last cut
            if seen + row["count"] >= n:
                cut, held = row["prefix"], row["count"]
                break
            seen += row["count"]
        if cut is None:
            return None
        inside = inside.where(prefix == cut)
        if held <= _ORDERED_ROWS or digits >= _HASH_DIGITS:
            break
    same = inside.groupBy("_rank").count().orderBy("_rank").toLocalIterator()
    for row in same:
        if seen + row["count"] >= n:
            return row["_rank"], n - seen
        seen += row["count"]


def holdout(df: DataFrame, n: int, seed: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exactly ``n`` rows without replacement, and the rest.

    The n-th smallest rank splits the table by a comparison, so neither side needs a sort or a
    join. It is found by counting rows per rank prefix and going deeper into the one prefix
    that holds the n-th row until few enough rows share it. Rows that are equal throughout
    share a rank; of those at the boundary as many are taken as are still wanted.
    """
    ranked = with_sample_rank(df, key, seed)
    found = _boundary(ranked, n) if n > 0 else None
    if found is None:
        nothing = df.where(F.lit(False))
        return (df, nothing) if n > 0 else (nothing, df)
    boundary, taken = found
    below, above = ranked.where(F.col("_rank") < boundary), ranked.where(F.col("_rank") > boundary)
    equal = ranked.where(F.col("_rank") == boundary)
    first = below.unionByName(equal.limit(taken)).drop("_rank")
    held = equal.count()
    rest = above if held == taken else above.unionByName(equal.limit(held - taken))
    return first, rest.drop("_rank")


def holdout_by(df: DataFrame, by: str, n: int, seed: int, key: list[str], share: int) -> DataFrame:
    """``df`` with ``held``: true for exactly ``n`` rows of each group, at most one in ``share``.

    Rows are ranked by a hash of their ``key``, which tells the rows of a group apart; rows that
    share a key share its side. Counts by rank prefix say which prefix of a group holds the
    boundary, and only the rows of that prefix are ordered, so a group of any size takes one pass
    over narrow rows. A null group is never held.
    """
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    narrow = df.where(F.col(by).isNotNull()).select(F.col(by).alias("_group"), rank.alias("_rank"))
    prefix = F.substring("_rank", 1, _STEP_DIGITS)
    group = W.partitionBy("_group")
    counted = narrow.groupBy("_group", prefix.alias("_prefix")).count().select(
        "_group", "_prefix", F.sum("count").over(group.orderBy("_prefix")).alias("upto"), "count",
        F.least(F.lit(n), F.floor(F.sum("count").over(group) / share)).alias("wanted"))
    before = F.col("upto") - F.col("count")
    cut = stage(counted.where((before < F.col("wanted")) & (F.col("upto") >= F.col("wanted"))).select(
        "_group", "_prefix", (F.col("wanted") - before).alias("left")), "cut")
    inside = narrow.withColumn("_prefix", prefix).join(cut, ["_group", "_prefix"])
    place = F.row_number().over(group.orderBy("_rank"))
    last = stage(inside.withColumn("place", place).where(F.col("place") == F.col("left")).select(
        "_group", F.col("_rank").alias("_last")), "boundary")
    held = F.coalesce(rank <= F.col("_last"), F.lit(False))
    return df.join(last, F.col(by) == F.col("_group"), "left").withColumn("held", held).drop("_group", "_last")


def complement(df: DataFrame, sample: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``sample``."""
    return df.join(sample.select(*key), key, "left_anti")
