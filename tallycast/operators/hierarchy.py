"""Twelve-level roll-up of the sales hierarchy.

The cells are summed once per (series, period). Levels 11 and 10 are summed from those,
and levels 1-9, which know nothing of items, from the much smaller
(state, store, category, department) sums. A single twelve-set expansion would multiply
every cell by twelve before the first partial sum; here each cell is read for one of
three partial sums, and hot nodes such as the total are combined map-side. Sums carry
their row and value counts, so both null rules stay exact through the cascade.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.ids import node_name
from tallycast.schema import KEYS, LEVELS, TOTAL_NAME

TOP_KEYS = ["state_id", "store_id", "cat_id", "dept_id"]


@dataclass(frozen=True)
class Measure:
    """A summed column, its null rule, and the rule of the bottom level if it differs."""

    column: str
    rule: str = "strict"
    bottom_rule: str | None = None

    def rule_at(self, level: int) -> str:
        return (self.bottom_rule or self.rule) if level == max(LEVELS) else self.rule

    @property
    def _parts(self) -> tuple[str, str, str]:
        return f"_s_{self.column}", f"_n_{self.column}", f"_k_{self.column}"

    def first_sums(self) -> list[Column]:
        s, n, k = self._parts
        return [
            F.sum(self.column).alias(s),
            F.count(F.lit(1)).alias(n),
            F.count(self.column).alias(k),
        ]

    def merged_sums(self) -> list[Column]:
        return [F.sum(part).alias(part) for part in self._parts]

    def result(self, level: Column) -> Column:
        s, n, k = (F.col(p) for p in self._parts)
        strict, lenient = F.when(n == k, s), F.coalesce(s, F.lit(0).cast("double"))
        values = {"strict": strict, "lenient": lenient}
        bottom = self.rule_at(max(LEVELS))
        if bottom == self.rule:
            return values[self.rule].alias(self.column)
        return F.when(level == max(LEVELS), values[bottom]).otherwise(values[self.rule]) \
            .alias(self.column)


def _top_level_id() -> Column:
    """Level from the grouping bits of TOP_KEYS (a set bit marks a key summed away)."""
    level = F.lit(None).cast("int")
    for level_id, cols in LEVELS.items():
        if set(cols) <= set(TOP_KEYS):
            bits = sum(1 << (len(TOP_KEYS) - 1 - i)
                       for i, key in enumerate(TOP_KEYS) if key not in cols)
            level = F.when(F.col("_bits") == bits, level_id).otherwise(level)
    return level


def rollup12(cells: DataFrame, measures: list[Measure] | str, rule: str = "strict",
             bottom_rule: str | None = None, period: str | None = "d") -> DataFrame:
    """Sum ``measures`` on all twelve levels -> (level_id, name, period, measures).

    ``cells`` holds the six keys and the period; several rows per cell are fine. With
    ``period=None`` the roll-up is over the keys alone.
    """
    if isinstance(measures, str):
        measures = [Measure(measures, rule, bottom_rule)]
    p = [period] if period else []
    merge = [s for m in measures for s in m.merged_sums()]
    parts = [c for m in measures for c in m._parts]

    base = cells.groupBy(*KEYS, *p).agg(*[s for m in measures for s in m.first_sums()])
    state_item = base.groupBy("state_id", "item_id", *p).agg(*merge)
    item = base.groupBy("item_id", *p).agg(*merge)
    stores = base.groupBy(*TOP_KEYS, *p).agg(*merge)

    sets = [[*cols, *p] for cols in LEVELS.values() if set(cols) <= set(TOP_KEYS)]
    top = stores.groupingSets(sets, *TOP_KEYS, *p).agg(
        (F.grouping("state_id") * 8 + F.grouping("store_id") * 4
         + F.grouping("cat_id") * 2 + F.grouping("dept_id")).alias("_bits"),
        *merge,
    )
    top_name = F.when(F.col("_bits") == 15, TOTAL_NAME).otherwise(node_name(*TOP_KEYS))
    branches = [
        top.select(_top_level_id().alias("level_id"), top_name.alias("name"), *p, *parts),
        item.select(F.lit(10).alias("level_id"), F.col("item_id").alias("name"), *p, *parts),
        state_item.select(
            F.lit(11).alias("level_id"), node_name("state_id", "item_id").alias("name"), *p, *parts
        ),
        base.select(F.lit(12).alias("level_id"), F.col("id").alias("name"), *p, *parts),
    ]
    nodes = branches[0]
    for branch in branches[1:]:
        nodes = nodes.unionByName(branch)
    return nodes.select(
        "level_id", "name", *p, *[m.result(F.col("level_id")) for m in measures]
    )
