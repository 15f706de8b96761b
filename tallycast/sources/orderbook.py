"""Demand tables derived from an order book (lineitem, part, supplier, nation, region).

Monthly view: a series is item x store, the period a month. Daily view: a series is
category x region, the period a day. Category, item, store and state come from the part
type, type+brand, nation and region.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators.ordering import with_position
from tallycast.schema import KEYS
from tallycast.session import stage

# The fixed-date events, and the day-of-month span of each region's support days.
EVENTS_1 = {
    (12, 25): ("Christmas", "National"),
    (1, 1): ("NewYear", "National"),
    (7, 4): ("IndependenceDay", "National"),
    (2, 14): ("ValentinesDay", "Cultural"),
}
EVENTS_2 = {(12, 25): ("WinterSale", "Cultural"), (7, 4): ("SummerSale", "Cultural")}
SNAP_DAYS = {
    "AFRICA": (1, 10),
    "AMERICA": (3, 12),
    "ASIA": (5, 14),
    "EUROPE": (7, 16),
    "MIDDLE EAST": (9, 18),
}
STATES = list(SNAP_DAYS)
DEPTS_PER_CATEGORY = 5


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def order_lines(spark: SparkSession, root: str) -> DataFrame:
    """Order lines with part type, brand and nation key; money as exact decimals.

    Left-deep joins to plain file scans: Spark knows each dimension's size, so the lines
    are shuffled only for a dimension too large to broadcast. Names are attached after
    the aggregation, which then groups and shuffles short keys.
    """
    part = _table(spark, root, "part").select("p_partkey", "p_type", "p_brand")
    supplier = _table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    lines = _table(spark, root, "lineitem").select(
        "l_partkey", "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("p_type", "p_brand", "s_nationkey", "date", "quantity", "amount")
    )


def _nations(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "nation").select(
        "n_nationkey", "n_regionkey", F.col("n_name").alias("store_id")
    )


def _regions(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "region").select("r_regionkey", F.col("r_name").alias("state_id"))


@dataclass(frozen=True)
class Bounds:
    """First and last shipping day of the order book; period 1 is that of the first day."""

    first: Date
    last: Date

    def month(self, date: Column | str) -> Column:
        return ((F.year(date) - self.first.year) * 12 + F.month(date) - (self.first.month - 1)).cast("int")

    def day(self, date: Column | str) -> Column:
        return F.datediff(F.to_date(date), F.lit(self.first)) + 1

    @property
    def n_months(self) -> int:
        return (self.last.year - self.first.year) * 12 + self.last.month - self.first.month + 1

    @property
    def n_days(self) -> int:
        return (self.last - self.first).days + 1


def order_bounds(spark: SparkSession, root: str) -> Bounds:
    """One aggregate over the shipping dates."""
    row = _table(spark, root, "lineitem").agg(
        F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b")).first()
    return Bounds(row["a"], row["b"])


def n_months(spark: SparkSession, root: str) -> int:
    """Months of the order book."""
    return order_bounds(spark, root).n_months


def _totals(lines: DataFrame, *keys: Column | str) -> DataFrame:
    """Quantity and amount per key: partial sums before the only shuffle."""
    return lines.groupBy(*keys).agg(
        F.sum("quantity").alias("sales"), F.sum("amount").alias("amount")
    )


def _price() -> Column:
    return F.try_divide(F.col("amount").cast("double"), F.col("sales"))


def densify(cells: DataFrame, keys: list[str], first: int, last: int, value: str = "sales",
            fill: float | None = 0.0) -> DataFrame:
    """All periods ``first..last`` of every series; absent cells get ``fill``.

    One shuffle on the series; a series holds at most ``last - first + 1`` cells.
    """
    by_period = F.map_from_entries(F.collect_list(F.struct("d", value)))
    filled = F.coalesce(F.try_element_at("by_period", F.col("d")), F.lit(fill).cast("double"))
    return (
        cells.where(F.col("d").between(first, last))
        .groupBy(*keys).agg(by_period.alias("by_period"))
        .select(*keys, "by_period", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d"))
        .select(*keys, "d", filled.alias(value))
    )


@dataclass(frozen=True)
class MonthlyView:
    """Monthly demand of item x store series; ``cells`` holds the non-empty months."""

    cells: DataFrame
    bounds: Bounds

    @property
    def last(self) -> int:
        return self.bounds.n_months

    def priced_cells(self) -> DataFrame:
        return self.cells.select(*KEYS, "d", "sales", _price().alias("sell_price"))

    def sales(self, fill: float | None = 0.0) -> DataFrame:
        """Dense monthly sales of every series (D2)."""
        return densify(self.cells.select(*KEYS, "d", "sales"), KEYS, 1, self.last, fill=fill)

    def prices(self) -> DataFrame:
        """Average price per (store, item, period), the period in the week column (D5)."""
        return self.cells.select(
            "store_id", "item_id", F.col("d").cast("int").alias("wm_yr_wk"),
            _price().alias("sell_price"),
        )

    def calendar(self) -> DataFrame:
        return calendar_months(self.cells.sparkSession, self.bounds)


def monthly_view(spark: SparkSession, root: str, staged: bool = False) -> MonthlyView:
    """The monthly view; ``staged`` writes its cells once for jobs that use them often."""
    bounds = order_bounds(spark, root)
    totals = _totals(order_lines(spark, root), "p_type", "p_brand", "s_nationkey",
                     bounds.month("date").alias("d"))
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    dept_no = (brand_no % DEPTS_PER_CATEGORY).cast("string")
    cells = (
        totals.join(_nations(spark, root), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_regions(spark, root), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat_ws("_", "p_type", "p_brand", "store_id").alias("id"),
            F.concat_ws("_", "p_type", "p_brand").alias("item_id"),
            F.concat_ws("_", "p_type", dept_no).alias("dept_id"),
            F.col("p_type").alias("cat_id"), "store_id", "state_id", "d", "sales", "amount",
        )
    )
    return MonthlyView(stage(cells, "monthly") if staged else cells, bounds)


def monthly_cells(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty (series, month) cells: sales and average price."""
    return monthly_view(spark, root).priced_cells()


def monthly_sales(spark: SparkSession, root: str, fill: float | None = 0.0) -> DataFrame:
    return monthly_view(spark, root).sales(fill)


def monthly_prices(spark: SparkSession, root: str) -> DataFrame:
    return monthly_view(spark, root).prices()


def monthly_calendar(spark: SparkSession, root: str) -> DataFrame:
    return calendar_months(spark, order_bounds(spark, root))


def calendar_months(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """One row per month: d, date of its first day, and d as the pricing period."""
    months = F.col("id").cast("int") - 1
    return spark.range(1, bounds.n_months + 1).select(
        F.col("id").cast("int").alias("d"),
        F.col("id").cast("int").alias("wm_yr_wk"),
        F.add_months(F.lit(bounds.first.replace(day=1)), months).alias("date"),
    )


@dataclass(frozen=True)
class DailyView:
    """Daily demand of category x region series; ``cells`` holds the non-empty days."""

    cells: DataFrame
    bounds: Bounds

    @property
    def last(self) -> int:
        return self.bounds.n_days

    def priced_cells(self) -> DataFrame:
        return self.cells.select(*KEYS, "d", "sales", _price().alias("price"))

    def sales(self) -> DataFrame:
        """Dense daily sales of every series (D2)."""
        return densify(self.cells.select(*KEYS, "d", "sales"), KEYS, 1, self.last)

    def weekly_prices(self) -> DataFrame:
        """Average price per (store, item, week) (D5)."""
        week = F.floor((F.col("d") - 1) / 7).cast("int")
        return self.cells.groupBy("store_id", "item_id", week.alias("wm_yr_wk")).agg(
            F.sum("sales").alias("sales"), F.sum("amount").alias("amount")
        ).select("store_id", "item_id", "wm_yr_wk", _price().alias("sell_price"))

    def daily_prices(self) -> DataFrame:
        """(id, d, price) of every day from a series' first week on: the price of the week, or
        of the newest week before it that has one. Days before the launch have no row."""
        weekly = self.weekly_prices().join(
            self.cells.select("store_id", "item_id", "id").distinct(), ["store_id", "item_id"])
        last = (self.last - 1) // 7
        # a series holds at most one price per week of the calendar
        known = F.sort_array(F.collect_list(F.struct(F.col("wm_yr_wk").alias("a"), "sell_price")))
        spans = weekly.groupBy("id").agg(known.alias("k")).select(
            "id", F.posexplode("k").alias("i", "w"),
            F.try_element_at("k.a", F.col("i") + 2).alias("next"))
        until = F.least(F.coalesce(F.col("next") * 7, F.lit(last * 7 + 7)), F.lit(self.last))
        return spans.select(
            "id", F.explode(F.sequence(F.col("w.a") * 7 + 1, until)).alias("d"),
            F.col("w.sell_price").alias("price"))

    def calendar(self, horizon: int = 28) -> DataFrame:
        return calendar_days(self.cells.sparkSession, self.bounds, horizon)

    def clusters(self) -> DataFrame:
        return category_clusters(self.cells)


def last_day(spark: SparkSession, root: str) -> int:
    """Newest day index of the order book."""
    return order_bounds(spark, root).n_days


def daily_view(spark: SparkSession, root: str, staged: bool = False) -> DailyView:
    """The daily view; ``staged`` writes its cells once for jobs that use them often."""
    nations = _nations(spark, root).drop("store_id")
    lines = order_lines(spark, root).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    bounds = order_bounds(spark, root)
    totals = _totals(lines, "p_type", "n_regionkey", bounds.day("date").alias("d"))
    cells = totals.join(_regions(spark, root), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("_", "p_type", "state_id").alias("id"), F.col("p_type").alias("item_id"),
        F.col("p_type").alias("dept_id"), F.col("p_type").alias("cat_id"),
        F.col("state_id").alias("store_id"), "state_id", "d", "sales", "amount",
    )
    return DailyView(stage(cells, "daily") if staged else cells, bounds)


def daily_cells(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty (series, day) cells with sales and average price."""
    return daily_view(spark, root).priced_cells()


def daily_sales(spark: SparkSession, root: str) -> DataFrame:
    return daily_view(spark, root).sales()


def weekly_prices(spark: SparkSession, root: str) -> DataFrame:
    return daily_view(spark, root).weekly_prices()


def daily_calendar(spark: SparkSession, root: str, horizon: int = 28) -> DataFrame:
    """Calendar from day 1 to ``horizon`` days past the newest order (D4)."""
    return calendar_days(spark, order_bounds(spark, root), horizon)


def _event(rules: dict, part: int) -> Column:
    label = F.lit(None).cast("string")
    for (month, day), names in rules.items():
        hit = (F.month("date") == month) & (F.dayofmonth("date") == day)
        label = F.when(hit, F.lit(names[part])).otherwise(label)
    return label


def calendar_days(spark: SparkSession, bounds: Bounds, horizon: int) -> DataFrame:
    """Calendar from the first day to ``horizon`` days past the last one.

    It is a projected ``range``, so Spark knows its size and broadcasts it by its own
    threshold.
    """
    days = spark.range(1, bounds.n_days + horizon + 1).select(
        F.col("id").cast("int").alias("d"),
        F.date_add(F.lit(bounds.first), F.col("id").cast("int") - 1).alias("date"),
    )
    snaps = {
        f"snap_{state}": F.dayofmonth("date").between(a, b).cast("int")
        for state, (a, b) in SNAP_DAYS.items()
    }
    return days.select(
        "d", "date",
        F.floor((F.col("d") - 1) / 7).cast("int").alias("wm_yr_wk"),
        F.date_format("date", "EEEE").alias("weekday"),
        # 1 = Saturday, as in the retail calendar
        (F.dayofweek("date") % 7 + 1).alias("wday"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        _event(EVENTS_1, 0).alias("event_name_1"),
        _event(EVENTS_1, 1).alias("event_type_1"),
        _event(EVENTS_2, 0).alias("event_name_2"),
        _event(EVENTS_2, 1).alias("event_type_2"),
        *[flag.alias(name) for name, flag in snaps.items()],
    )


def category_clusters(series: DataFrame) -> DataFrame:
    """(id, cluster_id): clusters numbered by category in alphabetical order."""
    numbered = with_position(series.select("cat_id").distinct(), [F.col("cat_id")]).select(
        "cat_id", F.col("position").cast("int").alias("cluster_id"))
    return series.select("id", "cat_id").distinct().join(numbered, "cat_id").select("id", "cluster_id")
