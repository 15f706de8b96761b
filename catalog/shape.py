"""Reshape, ids, flags, encodings and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import DAY0, KEYS, query, sql
from tallycast.functions import dates, ids
from tallycast.functions.nulls import clamp_nonneg
from tallycast.models import levels
from tallycast.models.design import default_design
from tallycast.operators import encode, filters, joins, lags, reshape, scoring
from tallycast.plans.assemble import horizon_labels, replicate_stage
from tallycast.schema import KEYS as KEY_COLS
from tallycast.sources import orderbook as ob

LAST = "(SELECT max(d) FROM sales)"

# -- the demand view itself ---------------------------------------------------------

query("demand_monthly", sql(
    f"SELECT {KEYS}, d, sales FROM sales", "sales"))(lambda s, r: ob.monthly_sales(s, r))
query("demand_daily", sql(
    f"SELECT {KEYS}, d, sales FROM dsales", "dsales"))(lambda s, r: ob.daily_sales(s, r))
query("prices_monthly", sql(
    "SELECT store_id, item_id, d AS wm_yr_wk, sell_price FROM cells", "cells"))(
    lambda s, r: ob.monthly_prices(s, r))
query("prices_daily", sql("SELECT id, d, round(price, 9) AS price FROM dprices WHERE price IS NOT NULL", "dprices"))(
    lambda s, r: ob.daily_view(s, r, staged=True).daily_prices().withColumn("price", F.round("price", 9)))


def order_days(s, r):
    """Orders with the calendar of their day."""
    orders = s.read.parquet(f"{r}/orders.parquet")
    bounds = ob.order_bounds(s, r)
    keyed = orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", bounds.day("o_orderdate").alias("d"),
                          F.to_date("o_orderdate").alias("order_date"))
    return keyed.join(ob.calendar_days(s, bounds, 28), "d", "left")


_ORDER_DAYS = f"""
  SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS order_date,
         CAST(CAST(o_orderdate AS DATE) - {DAY0} + 1 AS INT) AS d FROM orders"""

query("calendar_daily", sql("SELECT o.o_orderkey, o.d, c.* EXCLUDE (d) FROM odays o LEFT JOIN calendar c ON c.d = o.d",
                            "calendar", odays=_ORDER_DAYS))(
    lambda s, r: order_days(s, r).drop("o_orderpriority", "o_orderstatus", "order_date"))

# -- reshape ------------------------------------------------------------------------

def month_labels(s, r):
    return [f"d_{d}" for d in range(1, ob.n_months(s, r) + 1)]


def wide_monthly(s, r, fill=0.0):
    view = ob.monthly_view(s, r)
    labelled = view.sales(fill=fill).withColumn("label", ids.day_label("d"))
    return reshape.to_wide(labelled, KEY_COLS, "label", "sales", [f"d_{d}" for d in range(1, view.last + 1)])


@query("b1_to_long_keeps_nulls", sql(
    "SELECT k.id, 'd_' || g.d AS label, c.sales FROM (SELECT DISTINCT id FROM cells) k "
    "CROSS JOIN (SELECT unnest(range(1, max(d) + 1)) AS d FROM cells) g LEFT JOIN cells c ON c.id = k.id AND c.d = g.d", "cells"))
def to_long(s, r):
    wide = wide_monthly(s, r, fill=None).select("id", *month_labels(s, r))
    return reshape.to_long(wide, ["id"], "label", "sales")


@query("b2_to_wide", sql(
    "SELECT id, " + ", ".join(f"max(CASE WHEN d = m - 28 + {h} THEN sales END) AS F{h}" for h in range(1, 29))
    + " FROM sales, (SELECT max(d) AS m FROM sales) GROUP BY id", "sales"))
def to_wide(s, r):
    view = ob.monthly_view(s, r)
    tail = filters.last_n(view.sales(), view.last, 28)
    labelled = tail.withColumn("label", ids.horizon_label(F.col("d") - (view.last - 28)))
    return reshape.to_wide(labelled, ["id"], "label", "sales", horizon_labels(28))


@query("b3_node_name", sql(
    "SELECT DISTINCT state_id || '_' || cat_id AS name_6, store_id || '_' || dept_id AS name_9, "
    "state_id || '_' || item_id AS name_11 FROM cells", "cells"))
def node_names(s, r):
    return ob.monthly_cells(s, r).select(
        ids.node_name("state_id", "cat_id").alias("name_6"),
        ids.node_name("store_id", "dept_id").alias("name_9"),
        ids.node_name("state_id", "item_id").alias("name_11"),
    ).distinct()


@query("b4_period_index", sql(
    "SELECT label, CAST(substr(label, 3) AS INT) AS d, sum(sales) AS sales "
    "FROM (SELECT 'd_' || d AS label, sales FROM sales) GROUP BY label", "sales"))
def period_index(s, r):
    labelled = ob.monthly_sales(s, r).select(ids.day_label("d").alias("label"), "sales")
    return labelled.groupBy("label").agg(F.sum("sales").alias("sales")) \
        .select("label", ids.period_index("label").alias("d"), "sales")


@query("b5_relabel_horizon", sql(
    "SELECT id, d - 77 AS step, sales AS actual FROM sales WHERE d > 77", "sales"))
def relabel(s, r):
    test = ob.monthly_sales(s, r).where("d > 77").select("id", "d", "sales")
    stepped = reshape.to_horizon(test, 77).select("id", "h", "sales")
    return reshape.relabel(stepped, ["id", "step", "actual"])


@query("b6_shift_periods", sql(
    "SELECT id, d + 28 AS d, sales FROM sales WHERE d BETWEEN 50 AND 77", "sales"))
def shift_periods(s, r):
    window = filters.last_n(ob.monthly_sales(s, r), 77, 28).select("id", "d", "sales")
    return reshape.shift_periods(window, 28)


@query("b7_last_periods", sql(
    "SELECT id, d, sales FROM sales WHERE d > (SELECT max(d) FROM sales) - 28", "sales"))
def last_periods(s, r):
    view = ob.monthly_view(s, r)
    return reshape.last_periods(view.sales().select("id", "d", "sales"), 28, newest=view.last)


# -- ids ----------------------------------------------------------------------------

# Output ids as the task writes them, made from parts and nations.
_OUT_IDS = """
  SELECT DISTINCT CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'HOBBIES'
              WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'HOUSEHOLD' ELSE 'FOOD' END
         || '_' || (p_size % 3 + 1) || '_' || regexp_extract(p_brand, '([0-9]+)', 1) AS item_id,
         CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' ELSE 'WI' END
         || '_' || (n_nationkey % 4 + 1) AS store_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey"""


def output_lines(s, r):
    """Order lines with (item_id, store_id) in the style of the output ids."""
    line = s.read.parquet(f"{r}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    part = s.read.parquet(f"{r}/part.parquet")
    supplier = s.read.parquet(f"{r}/supplier.parquet")
    nation = s.read.parquet(f"{r}/nation.parquet")
    cat = F.when(F.col("p_type").isin("STANDARD", "MEDIUM"), "HOBBIES") \
        .when(F.col("p_type").isin("LARGE", "ECONOMY"), "HOUSEHOLD").otherwise("FOOD")
    state = F.when(F.col("n_regionkey") == 0, "CA").when(F.col("n_regionkey") == 1, "TX").otherwise("WI")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            ids.node_name(cat, (F.col("p_size") % 3 + 1).cast("string"),
                          F.regexp_extract("p_brand", r"(\d+)", 1)).alias("item_id"),
            ids.node_name(state, (F.col("n_nationkey") % 4 + 1).cast("string")).alias("store_id"),
            "l_shipdate", "l_quantity",
        )
    )


def output_names(s, r):
    """Distinct (item_id, store_id) of the output ids."""
    return output_lines(s, r).select("item_id", "store_id").distinct()


@query("b8_make_id", sql(
    "SELECT item_id || '_' || store_id || '_validation' AS id FROM names", names=_OUT_IDS))
def make_id(s, r):
    return output_names(s, r).select(ids.make_id("item_id", "store_id", "validation").alias("id"))


@query("b9_strip_stage", sql(
    "SELECT item_id || '_' || store_id || st AS id, item_id || '_' || store_id AS series "
    "FROM names CROSS JOIN (VALUES ('_validation'), ('_evaluation')) v(st)", names=_OUT_IDS))
def strip_stage(s, r):
    both = replicate_stage(make_id(s, r))
    return both.select("id", ids.strip_stage("id").alias("series"))


@query("b10_restage", sql(
    "SELECT item_id || '_' || store_id || '_evaluation' AS id FROM names", names=_OUT_IDS))
def restage(s, r):
    return make_id(s, r).select(ids.restage("id").alias("id"))


@query("b11_parse_id", sql(
    "SELECT item_id || '_' || store_id || '_validation' AS id, split_part(store_id, '_', 1) AS state_id, "
    "split_part(item_id, '_', 1) AS cat_id, item_id, store_id, 'validation' AS stage FROM names",
    names=_OUT_IDS))
def parse_id(s, r):
    return make_id(s, r).withColumns(ids.parse_id("id"))


# -- calendar flags -----------------------------------------------------------------

query("b12_day_of_month", sql(
    "SELECT o_orderkey, CAST(day(order_date) AS INT) AS day FROM odays", odays=_ORDER_DAYS))(
    lambda s, r: order_days(s, r).select(
        "o_orderkey", dates.day_of_month(F.date_format("order_date", "yyyy-MM-dd")).alias("day")))
query("b13_weekday_flag", sql(
    "SELECT o_orderkey, CASE WHEN dayofweek(order_date) IN (0, 6) THEN 0 ELSE 1 END AS weekday_flag FROM odays",
    odays=_ORDER_DAYS))(
    lambda s, r: order_days(s, r).select(
        "o_orderkey", dates.weekday_flag(F.date_format("order_date", "EEEE")).alias("weekday_flag")))
query("b14_weekend_flag", sql(
    "SELECT o_orderkey, CASE WHEN dayofweek(order_date) IN (0, 6) THEN 1 ELSE 0 END AS weekend FROM odays",
    odays=_ORDER_DAYS))(
    lambda s, r: order_days(s, r).select(
        "o_orderkey", dates.weekend_flag(F.date_format("order_date", "EEEE")).alias("weekend")))


@query("b15_snap_for_state", sql(
    "SELECT s.id, s.d, e.snap FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id",
    "dsales", "externals"))
def snap_for_state(s, r):
    cal = ob.daily_calendar(s, r)
    snaps = cal.select("d", *[F.col(f"`snap_{x}`") for x in ob.STATES])
    return ob.daily_sales(s, r).select("id", "state_id", "d").join(snaps, "d") \
        .select("id", "d", dates.snap_for_state("state_id", ob.STATES).alias("snap"))


query("b16_fill_event", sql(
    "SELECT o_orderkey, coalesce(event_name_1, 'no_event_name_1') AS event_name_1, "
    "coalesce(event_type_2, 'no_event_type_2') AS event_type_2 FROM odays LEFT JOIN calendar USING (d)",
    "calendar", odays=_ORDER_DAYS))(
    lambda s, r: order_days(s, r).select(
        "o_orderkey", *[dates.fill_event(c).alias(c) for c in ("event_name_1", "event_type_2")]))


@query("b17_encode_first_seen", sql("""
SELECT o.o_orderkey, CAST(p.code AS INT) AS o_orderpriority, CAST(n.code AS INT) AS event_name_1
FROM e o
JOIN (SELECT v, row_number() OVER (ORDER BY f, v) AS code FROM
      (SELECT o_orderpriority AS v, min(d) AS f FROM e GROUP BY 1)) p ON p.v = o.o_orderpriority
JOIN (SELECT v, row_number() OVER (ORDER BY f, v) AS code FROM
      (SELECT coalesce(event_name_1, '') AS v, min(d) AS f FROM e GROUP BY 1)) n
  ON n.v = coalesce(o.event_name_1, '')""", "calendar", odays=_ORDER_DAYS,
    e="SELECT odays.*, event_name_1, weekday FROM odays LEFT JOIN calendar USING (d)"))
def encode_first_seen(s, r):
    rows = order_days(s, r).select("o_orderkey", "d", "o_orderpriority", "event_name_1")
    return encode.encode_first_seen(rows, rows, ["o_orderpriority", "event_name_1"]).drop("d")


@query("b18_encode_sorted", sql("""
SELECT o_orderkey, CAST(coalesce(n.code, 0) AS INT) AS event_name_1,
       CAST(coalesce(w.code - (SELECT min(CASE WHEN weekday IS NULL THEN 0 ELSE 1 END) FROM e), 0) AS INT) AS weekday
FROM e
LEFT JOIN (SELECT event_name_1 AS v, row_number() OVER (ORDER BY event_name_1) AS code
           FROM (SELECT DISTINCT event_name_1 FROM e WHERE event_name_1 IS NOT NULL)) n
  ON n.v = e.event_name_1
LEFT JOIN (SELECT weekday AS v, row_number() OVER (ORDER BY weekday) AS code
           FROM (SELECT DISTINCT weekday FROM e WHERE weekday IS NOT NULL)) w ON w.v = e.weekday""", "calendar", odays=_ORDER_DAYS,
    e="SELECT odays.*, event_name_1, weekday FROM odays LEFT JOIN calendar USING (d)"))
def encode_sorted(s, r):
    """Orders before the first shipping day have no calendar; their missing values take code 0."""
    rows = order_days(s, r).select("o_orderkey", "event_name_1", "weekday")
    return encode.encode_sorted(rows, ["event_name_1", "weekday"])


@query("b19_cast_features", sql("""
SELECT e.state_id, s.id, s.d,
       CAST(e.weekday_flag = 0 AS DOUBLE) AS is_weekend, CAST(e.weekday_flag = 1 AS DOUBLE) AS is_weekday,
       CAST(e.snap = 1 AS DOUBLE) AS is_snap, CAST(e.month = 12 AS DOUBLE) AS is_december
FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id""", "dsales", "externals"))
def cast_features(s, r):
    cal = ob.daily_calendar(s, r)
    design = default_design(cal, 0, calendar_factors=("weekday_flag", "snap", "month"))
    rows = joins.external_vars(ob.daily_sales(s, r).select("id", "state_id", "d"), cal)
    at = {n: F.element_at("_x", i + 1) for i, n in enumerate(design.names)}
    return rows.withColumn("_x", design.values()).select(
        "state_id", "id", "d", at["weekday_flag=0"].alias("is_weekend"),
        at["weekday_flag=1"].alias("is_weekday"), at["snap=1"].alias("is_snap"),
        at["month=12"].alias("is_december"),
    )


@query("b19_sparse_levels", sql("""
SELECT factor, level, row_number() OVER (PARTITION BY factor ORDER BY level) - 1 AS code FROM (
  SELECT DISTINCT 'customer' AS factor, CAST(o_custkey AS VARCHAR) AS level FROM orders
  UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders)"""))
def sparse_levels(s, r):
    """Level tables of a factor as long as the customers and of a short one."""
    orders = s.read.parquet(f"{r}/orders.parquet").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    return levels.level_table(orders, ["customer", "priority"])


@query("b19_sparse_fit", sql("""
SELECT CAST(o_custkey AS VARCHAR) AS level, round(avg(o_totalprice / 100000), 3) AS beta FROM orders GROUP BY o_custkey"""))
def sparse_fit(s, r):
    """Least squares over one column per customer: the customer's mean."""
    orders = s.read.parquet(f"{r}/orders.parquet").select(
        F.col("o_custkey").alias("customer"), (F.col("o_totalprice") / 100000).alias("y"))
    fitted = levels.fit_sparse_linear(orders, levels.level_table(orders, ["customer"]), ["customer"])
    return fitted.select("level", F.round("beta", 3).alias("beta"))


query("b20_projection", sql("SELECT id, d, sales FROM cells", "cells"))(
    lambda s, r: ob.monthly_cells(s, r).drop("item_id", "dept_id", "cat_id", "store_id", "state_id", "sell_price"))


@query("b21_clamp_nonneg", sql(
    "SELECT id, d, greatest(2 * sales - 40, 0) AS yhat FROM sales", "sales"))
def clamp(s, r):
    return ob.monthly_sales(s, r).select("id", "d", clamp_nonneg(F.col("sales") * 2 - 40).alias("yhat"))


query("b22_fill_missing", sql("SELECT id, d, sales FROM sales", "sales"))(
    lambda s, r: ob.monthly_sales(s, r, fill=None).select("id", "d", "sales").fillna(0.0))
query("b23_revenue", sql(
    "SELECT id, d, sales * sell_price AS revenue FROM cells", "cells"))(
    lambda s, r: ob.monthly_cells(s, r).select("id", "d", scoring.revenue().alias("revenue")))


@query("b24_horizon_label", sql(
    "SELECT id, 'F' || row_number() OVER (PARTITION BY id ORDER BY d) AS label, sales "
    f"FROM sales WHERE d > {LAST} - 28", "sales"))
def horizon_label(s, r):
    view = ob.monthly_view(s, r)
    tail = filters.last_n(view.sales(), view.last, 28)
    return lags.cumulative_count(tail).select("id", ids.horizon_label("n").alias("label"), "sales")


@query("b25_static_ids_on_windows", sql(
    "SELECT dept_id, state_id, count(*) AS n_windows FROM sales WHERE d > 56 GROUP BY ALL", "sales"))
def static_ids(s, r):
    rows = lags.embed(ob.monthly_sales(s, r), 56)
    return rows.groupBy("dept_id", "state_id").agg(F.count(F.lit(1)).alias("n_windows"))


# -- filters ------------------------------------------------------------------------

query("c1_last_n_before_cutoff", sql(
    "SELECT id, d, sales FROM sales WHERE d BETWEEN 50 AND 77", "sales"))(
    lambda s, r: filters.last_n(ob.monthly_sales(s, r), 77, 28).select("id", "d", "sales"))


@query("c2_between_dates", sql(
    "SELECT id, d, sales FROM dsales WHERE d BETWEEN DATE '2000-05-23' - (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + 1 "
    "AND DATE '2000-06-19' - (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + 1", "dsales"))
def between_dates(s, r):
    rows = ob.daily_sales(s, r).select("id", "d", "sales")
    return filters.between_dates(rows, ob.daily_calendar(s, r), "2000-05-23", "2000-06-19") \
        .select("id", "d", "sales")


@query("c3_before_date", sql(
    "SELECT id, d, sales FROM dsales WHERE (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + (d - 1) < DATE '2000-05-23'", "dsales"))
def before_date(s, r):
    rows = ob.daily_sales(s, r).select("id", "d", "sales")
    return filters.before_date(rows, ob.daily_calendar(s, r), "2000-05-23").select("id", "d", "sales")


def priced_monthly(s, r):
    return joins.with_price(ob.monthly_sales(s, r), ob.monthly_calendar(s, r), ob.monthly_prices(s, r))


@query("c4_mask_unavailable", sql(
    "SELECT id, d, CASE WHEN d >= min(d) FILTER (WHERE sell_price IS NOT NULL) OVER (PARTITION BY id) "
    "THEN sales END AS sales FROM sales", "sales"))
def mask_unavailable(s, r):
    """Months before the launch are missing; later months without a sale keep their zero."""
    view = ob.monthly_view(s, r, staged=True)
    return filters.mask_off_sale(view.sales(), view.calendar(), view.prices()).select("id", "d", "sales")


@query("c4_withdrawn", sql("""
SELECT id, count(*) AS periods, count(value) AS on_sale, count(*) FILTER (WHERE value = 0) AS zeros
FROM (SELECT id, CASE WHEN d BETWEEN min(d) FILTER (WHERE sell_price IS NOT NULL) OVER w
        AND max(d) FILTER (WHERE sell_price IS NOT NULL) OVER w THEN sales END AS value
      FROM sales WINDOW w AS (PARTITION BY id)) GROUP BY id""", "sales"))
def mask_withdrawn(s, r):
    """Intervals that also end, with the last priced month."""
    view = ob.monthly_view(s, r, staged=True)
    masked = filters.mask_off_sale(view.sales(), view.calendar(), view.prices(), withdrawn=True)
    return masked.groupBy("id").agg(F.count("*").alias("periods"), F.count("sales").alias("on_sale"),
                                    F.count_if(F.col("sales") == 0).alias("zeros"))


@query("c5_drop_incomplete", sql("""
SELECT id, d, sales, lag1, lag2 FROM (
  SELECT id, d, sales, lag(sales, 1) OVER w AS lag1, lag(sales, 2) OVER w AS lag2 FROM sales
  WINDOW w AS (PARTITION BY id ORDER BY d)) WHERE lag2 IS NOT NULL""", "sales"))
def drop_incomplete(s, r):
    rows = lags.add_lags(ob.monthly_sales(s, r).select("id", "d", "sales"), 2)
    return filters.drop_incomplete(rows)


@query("c6_split_calendar", sql("""
SELECT o_orderkey, CASE WHEN d > m - 28 THEN 'unused' WHEN d > m - 56 THEN 'test' ELSE 'train' END AS part
FROM odays, (SELECT max(d) AS m FROM odays)""", odays=_ORDER_DAYS))
def split_calendar(s, r):
    parts = filters.split_calendar(order_days(s, r).select("o_orderkey", "d"), 28)
    tagged = [df.select("o_orderkey", F.lit(name).alias("part")) for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("c7_first_stage", sql(
    "SELECT item_id || '_' || store_id || '_validation' AS id FROM names", names=_OUT_IDS))
def first_stage(s, r):
    return filters.first_stage(replicate_stage(make_id(s, r)))


query("c8_at_period", sql("SELECT id, sales FROM sales WHERE d = 80", "sales"))(
    lambda s, r: filters.at_period(ob.monthly_sales(s, r), 80).select("id", "sales"))
