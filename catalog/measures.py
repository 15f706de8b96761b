"""Joins, roll-ups, scores, lags, sampling and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import KEYS, lenient_sum, levels_sql, query, sql, strict_sum
from catalog.shape import _OUT_IDS, make_id, priced_monthly

from tallycast.operators import (
    filters, hierarchy, joins, lags, ordering, sampling, scoring, series,
)
from tallycast.plans import assemble, forecast, score
from tallycast.schema import KEYS as KEY_COLS
from tallycast.session import checkpoint_root, fingerprint
from tallycast.sources import orderbook as ob

CUTOFF, H = 77, 6  # monthly hold-out: months 78..83

# -- joins --------------------------------------------------------------------------


@query("e1_daily_prices", sql("""
SELECT c.date, c.d, c.wm_yr_wk, p.store_id, p.item_id, p.sell_price
FROM calendar c LEFT JOIN wprices p USING (wm_yr_wk)""", "calendar", "wprices"))
def daily_prices(s, r):
    return joins.daily_prices(ob.daily_calendar(s, r), ob.weekly_prices(s, r))


@query("e2_with_price", sql("""
SELECT s.id, s.d, s.sales, p.sell_price FROM dsales s
LEFT JOIN wprices p ON p.store_id = s.store_id AND p.item_id = s.item_id
  AND p.wm_yr_wk = CAST(floor((s.d - 1) / 7) AS INT)""", "dsales", "wprices"))
def with_price(s, r):
    rows = joins.with_price(ob.daily_sales(s, r), ob.daily_calendar(s, r), ob.weekly_prices(s, r))
    return rows.select("id", "d", "sales", "sell_price")


@query("e3_with_calendar", sql(
    "SELECT s.id, s.d, s.sales, c.weekday, c.month, c.event_name_1 FROM dsales s JOIN calendar c USING (d)",
    "dsales", "calendar"))
def with_calendar(s, r):
    return joins.with_calendar(ob.daily_sales(s, r), ob.daily_calendar(s, r)) \
        .select("id", "d", "sales", "weekday", "month", "event_name_1")


@query("e4_with_daily_price", sql(
    "SELECT s.id, s.d, s.sales, c.price FROM dsales s JOIN dcells c ON c.id = s.id AND c.d = s.d", "dsales"))
def with_daily_price(s, r):
    rows = ob.daily_sales(s, r).select("id", "d", "sales")
    return joins.with_daily_price(rows, ob.daily_cells(s, r))


@query("e5_join_on_common_keys", sql(
    "SELECT id, d, sales, sell_price FROM sales WHERE sell_price IS NOT NULL", "sales"))
def common_keys(s, r):
    rows = joins.with_price(ob.monthly_sales(s, r), ob.monthly_calendar(s, r),
                            ob.monthly_prices(s, r), how="inner")
    return rows.select("id", "d", "sales", "sell_price")


@query("e6_refresh_price", sql("""
SELECT k.id, CAST(2400 + h.h AS INT) AS d, CAST(h.h AS INT) AS h, p.sell_price
FROM (SELECT DISTINCT id, store_id, item_id FROM dcells) k CROSS JOIN range(1, 29) h(h)
LEFT JOIN wprices p ON p.store_id = k.store_id AND p.item_id = k.item_id
  AND p.wm_yr_wk = CAST(floor((2400 + h.h - 1) / 7) AS INT)""", "dcells", "wprices"))
def refresh_price(s, r):
    keys = ob.daily_cells(s, r).select(*KEY_COLS).distinct()
    frame = joins.future_frame(keys, ob.daily_calendar(s, r), 2400, 28, ob.weekly_prices(s, r))
    return frame.select("id", "d", "h", "sell_price")


@query("e7_with_hierarchy", sql(f"""
SELECT {KEYS}, h, yhat FROM (SELECT DISTINCT {KEYS} FROM cells)
LEFT JOIN (SELECT id, 1 AS h, sales AS yhat FROM cells WHERE d = 77) USING (id)""", "cells"))
def with_hierarchy(s, r):
    cells = ob.monthly_cells(s, r)
    fc = cells.where("d = 77").select("id", F.lit(1).alias("h"), F.col("sales").alias("yhat"))
    return joins.with_hierarchy(fc, cells.select(*KEY_COLS).distinct())


_EXTERNALS = "e.month, e.snap, e.weekday_flag, e.wday, e.day, e.event_name_1, e.event_name_2, e.event_type_1, e.event_type_2"
EXTERNALS = ["month", "snap", "weekday_flag", "wday", "day",
             "event_name_1", "event_name_2", "event_type_1", "event_type_2"]


@query("e8_external_vars", sql(
    f"SELECT s.id, s.d, {_EXTERNALS} FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id",
    "dsales", "externals"))
def external_vars(s, r):
    rows = ob.daily_sales(s, r).select("id", "state_id", "d")
    return joins.external_vars(rows, ob.daily_calendar(s, r)).select("id", "d", *EXTERNALS)


@query("e9_external_vars_with_price", sql(f"""
SELECT s.id, s.state_id, s.cat_id, s.d, {_EXTERNALS}, p.sell_price
FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id
LEFT JOIN wprices p ON p.store_id = s.store_id AND p.item_id = s.item_id
  AND p.wm_yr_wk = CAST(floor((s.d - 1) / 7) AS INT)""", "dsales", "externals", "wprices"))
def external_vars_with_price(s, r):
    rows = ob.daily_sales(s, r).drop("sales")
    return joins.external_vars(rows, ob.daily_calendar(s, r), ob.weekly_prices(s, r)) \
        .select("id", "state_id", "cat_id", "d", *EXTERNALS, "sell_price")


@query("e10_future_frame", sql(f"""
SELECT k.id, CAST(e.d - m.m AS INT) AS h, e.d, {_EXTERNALS}
FROM (SELECT DISTINCT id, state_id FROM dcells) k, (SELECT max(d) AS m FROM dcells) m, externals e
WHERE e.state_id = k.state_id AND e.d > m.m""", "dcells", "externals"))
def future_frame(s, r):
    last = ob.last_day(s, r)
    keys = ob.daily_cells(s, r).select("id", "state_id").distinct()
    return joins.future_frame(keys, ob.daily_calendar(s, r), last, 28).select("id", "h", "d", *EXTERNALS)


@query("e12_keyed_add", sql(f"""
SELECT id, CAST(h AS INT) AS h, round(last + season[h], 6) AS total FROM (
  SELECT id, max(sales) FILTER (WHERE d = {CUTOFF}) AS last,
         list(sales ORDER BY d) FILTER (WHERE d BETWEEN {CUTOFF} - 11 AND {CUTOFF} - 12 + {H}) AS season
  FROM sales GROUP BY id) CROSS JOIN range(1, {H + 1}) g(h)""", "sales"))
def keyed_add(s, r):
    sales = ob.monthly_view(s, r, staged=True).sales()
    a = forecast.naive(sales, CUTOFF, H)
    b = forecast.seasonal_naive(sales, CUTOFF, H, 12).withColumnRenamed("yhat", "other")
    return a.join(b, ["id", "h"]).select("id", "h", F.round(F.col("yhat") + F.col("other"), 6).alias("total"))


# -- hierarchy ----------------------------------------------------------------------

_PRICED = f"SELECT {KEYS}, d, CASE WHEN sell_price IS NOT NULL THEN sales END AS value FROM sales"
# missing before the first period with a price
_MASKED = (f"SELECT {KEYS}, d, CASE WHEN d >= min(d) FILTER (WHERE sell_price IS NOT NULL) "
           "OVER (PARTITION BY id) THEN sales END AS value FROM sales")

query("f1_rollup12_lenient", sql(
    levels_sql("sales", "sum(sales) AS sales"), "sales"))(
    lambda s, r: hierarchy.rollup12(ob.monthly_sales(s, r), "sales", "lenient"))


@query("f1_rollup12_strict", sql(
    levels_sql("masked", strict_sum("value") + " AS value"), "sales", masked=_PRICED))
def rollup_strict(s, r):
    masked = filters.mask_unavailable(priced_monthly(s, r)).withColumnRenamed("sales", "value")
    return hierarchy.rollup12(masked, "value", "strict")


@query("f2_level_sizes", sql(
    "SELECT level_id, count(DISTINCT name) AS nodes, sum(sales) AS sales FROM n GROUP BY level_id",
    "sales", n=levels_sql("sales", "sum(sales) AS sales")))
def level_sizes(s, r):
    nodes = hierarchy.rollup12(ob.monthly_sales(s, r), "sales", "lenient", period=None)
    return nodes.groupBy("level_id").agg(F.count("name").alias("nodes"), F.sum("sales").alias("sales"))


@query("f3_node_schema", sql(
    levels_sql("cells", "sum(sales) AS value"), "cells"))
def node_schema(s, r):
    cells = ob.monthly_cells(s, r).withColumnRenamed("sales", "value")
    return hierarchy.rollup12(cells, "value", "lenient").select("level_id", "name", "d", "value")


def _revenue(rule: str, cutoff: int = CUTOFF) -> str:
    total = {"strict": strict_sum, "lenient": lenient_sum}[rule]("sales * sell_price")
    return f"SELECT {KEYS}, {total} AS revenue FROM sales WHERE d BETWEEN {cutoff - H + 1} AND {cutoff} GROUP BY {KEYS}"


def _series_revenue(s, r, rule):
    view = ob.monthly_view(s, r, staged=True)
    return scoring.series_revenue(view.sales(), view.calendar(), view.prices(), CUTOFF, H, rule)


for _rule in ("strict", "lenient"):
    query(f"f4_series_revenue_{_rule}", sql(
        f"SELECT {KEYS}, round(revenue, 4) AS revenue FROM rev", "sales", rev=_revenue(_rule)))(
        lambda s, r, rule=_rule: _series_revenue(s, r, rule).withColumn("revenue", F.round("revenue", 4)))

query("f5_grand_total", sql(
    "SELECT round(sum(revenue), 4) AS total FROM rev", "sales", rev=_revenue("lenient")))(
    lambda s, r: scoring.grand_total(_series_revenue(s, r, "lenient")).select(F.round("total", 4).alias("total")))

_SHARES = levels_sql("rev", "sum(revenue) AS revenue", period=None)
_WEIGHTS = ("SELECT level_id, name, CASE WHEN level_id = 1 THEN 1.0 ELSE revenue / "
            "(SELECT nullif(sum(revenue), 0) FROM rev) END / 12 AS weight FROM shares")


@query("f6_weights12", sql(
    "SELECT level_id, name, round(weight, 9) AS weight FROM w", "sales",
    rev=_revenue("lenient"), shares=_SHARES, w=_WEIGHTS))
def weights(s, r):
    w = scoring.weights12(_series_revenue(s, r, "lenient"))
    return w.withColumn("weight", F.round("weight", 9))


_TRAIN = _MASKED + f" WHERE d <= {CUTOFF}"
_TRAIN_NODES = levels_sql("train", lenient_sum("value") + " AS value", bottom=strict_sum("value") + " AS value")
_SCALE = """
SELECT level_id, name, sum(step * step) / nullif(count(value) - 1, 0) AS scale FROM (
  SELECT level_id, name, value, value - lag(value) OVER (PARTITION BY level_id, name ORDER BY d) AS step
  FROM train_nodes WHERE value IS NOT NULL
  UNION ALL SELECT DISTINCT level_id, name, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM train_nodes)
GROUP BY level_id, name"""


def _train_nodes(s, r):
    view = ob.monthly_view(s, r, staged=True)
    train = view.sales().where(F.col("d") <= CUTOFF)
    return score.train_hierarchy(train, view.calendar(), view.prices())


@query("f7_scale", sql(
    "SELECT level_id, name, round(scale, 6) AS scale FROM scl", "sales",
    train=_TRAIN, train_nodes=_TRAIN_NODES, scl=_SCALE))
def scale(s, r):
    return scoring.scale(_train_nodes(s, r)).withColumn("scale", F.round("scale", 6))


FORECASTS = {
    "naive": (
        lambda sales, c, h: forecast.naive(sales, c, h),
        "SELECT a.id, b.h, a.sales AS yhat FROM sales a CROSS JOIN (SELECT unnest(range(1, {h} + 1)) AS h) b WHERE a.d = {c}"),
    "seasonal": (
        lambda sales, c, h: forecast.seasonal_naive(sales, c, h, 12),
        "SELECT id, d - ({c} - 12) AS h, sales AS yhat FROM sales WHERE d BETWEEN {c} - 11 AND {c} - 12 + {h}"),
    "mean": (
        lambda sales, c, h: forecast.mean_forecast(sales, c, h),
        "SELECT a.id, b.h, a.yhat FROM (SELECT id, avg(sales) AS yhat FROM sales WHERE d <= {c} GROUP BY id) a "
        "CROSS JOIN (SELECT unnest(range(1, {h} + 1)) AS h) b"),
}


def _score_ctes(kind: str) -> dict[str, str]:
    return dict(
        train=_TRAIN, train_nodes=_TRAIN_NODES, scl=_SCALE,
        rev=_revenue("lenient"), shares=_SHARES, w=_WEIGHTS,
        fc=FORECASTS[kind][1].format(c=CUTOFF, h=H),
        act=f"SELECT {KEYS}, d - {CUTOFF} AS h, sales FROM sales WHERE d > {CUTOFF}",
        cell="SELECT act.*, fc.yhat FROM act LEFT JOIN fc ON fc.id = act.id AND fc.h = act.h",
        pairs=levels_sql("cell", f"{lenient_sum('sales')} AS sales, {strict_sum('yhat')} AS yhat", "h"),
        err="SELECT level_id, name, CASE WHEN count(*) = count((sales - yhat)) THEN "
            "avg((sales - yhat) * (sales - yhat)) END AS mse FROM pairs GROUP BY ALL",
        scored="SELECT scl.level_id, scl.name, scale, mse, sqrt(mse / nullif(scale, 0)) AS rmsse, weight, "
               "sqrt(mse / nullif(scale, 0)) * weight AS wrmsse FROM scl "
               "LEFT JOIN err USING (level_id, name) LEFT JOIN w USING (level_id, name)",
    )


def score_root(s, r):
    """Where stored score inputs lie, and the state of the tables they come from."""
    tables = ("lineitem", "part", "supplier", "nation", "region")
    return f"{checkpoint_root(s).rstrip('/')}/tallycast/score-inputs", \
        fingerprint(s, *[f"{r}/{t}.parquet" for t in tables])


def _node_scores(s, r, kind):
    view = ob.monthly_view(s, r, staged=True)
    sales = view.sales()
    root, source = score_root(s, r)
    inputs = score.stored_inputs(sales, view.calendar(), view.prices(), CUTOFF, H, "lenient",
                                 root, f"monthly {source}")
    return inputs.score(FORECASTS[kind][0](sales, CUTOFF, H))


query("f8_mse", sql("SELECT level_id, name, round(mse, 6) AS mse FROM err", "sales", **_score_ctes("naive")))(
    lambda s, r: _node_scores(s, r, "naive").select("level_id", "name", F.round("mse", 6).alias("mse")))
query("f9_rmsse", sql("SELECT level_id, name, round(rmsse, 6) AS rmsse FROM scored", "sales", **_score_ctes("seasonal")))(
    lambda s, r: _node_scores(s, r, "seasonal").select("level_id", "name", F.round("rmsse", 6).alias("rmsse")))

for _kind in FORECASTS:
    query(f"f10_wrmsse_{_kind}", sql(
        "SELECT level_id, name, round(scale, 4) AS scale, round(mse, 4) AS mse, round(rmsse, 6) AS rmsse, "
        "round(weight, 9) AS weight, round(wrmsse, 9) AS wrmsse FROM scored", "sales", **_score_ctes(_kind)))(
        lambda s, r, kind=_kind: _node_scores(s, r, kind).select(
            "level_id", "name", F.round("scale", 4).alias("scale"), F.round("mse", 4).alias("mse"),
            F.round("rmsse", 6).alias("rmsse"), F.round("weight", 9).alias("weight"),
            F.round("wrmsse", 9).alias("wrmsse")))

query("f10_wrmsse_by_level", sql(
    "SELECT level_id, round(CASE WHEN count(*) = count(wrmsse) THEN sum(wrmsse) END * 12, 7) AS wrmsse "
    "FROM scored GROUP BY level_id", "sales", **_score_ctes("seasonal")))(
    lambda s, r: scoring.wrmsse_by_level(_node_scores(s, r, "seasonal")).withColumn("wrmsse", F.round("wrmsse", 7)))
query("e11_unscored_nodes", sql(
    "SELECT level_id, name, round(scale, 4) AS scale, round(mse, 4) AS mse, round(weight, 9) AS weight "
    "FROM scored WHERE wrmsse IS NULL", "sales", **_score_ctes("naive")))(
    lambda s, r: scoring.unscored(_node_scores(s, r, "naive")).select(
        "level_id", "name", F.round("scale", 4).alias("scale"), F.round("mse", 4).alias("mse"),
        F.round("weight", 9).alias("weight")))

# the final score, on the daily view (every node varies there, so it is finite)
D_CUT = 2400


def _daily_ctes() -> dict[str, str]:
    c = _score_ctes("naive")
    price = ("SELECT s.*, p.sell_price FROM dsales s LEFT JOIN wprices p ON p.store_id = s.store_id "
             "AND p.item_id = s.item_id AND p.wm_yr_wk = CAST(floor((s.d - 1) / 7) AS INT)")
    return {
        "sales": price, **c,
        "train": _MASKED + f" WHERE d <= {D_CUT}",
        "rev": _revenue("lenient").replace(f"d BETWEEN {CUTOFF - H + 1} AND {CUTOFF}", f"d BETWEEN {D_CUT - 27} AND {D_CUT}"),
        "fc": f"SELECT a.id, a.d - ({D_CUT} - 28) AS h, a.sales AS yhat FROM sales a WHERE a.d BETWEEN {D_CUT} - 27 AND {D_CUT}",
        "act": f"SELECT {KEYS}, d - {D_CUT} AS h, sales FROM sales WHERE d BETWEEN {D_CUT + 1} AND {D_CUT + 28}",
    }


@query("f10_wrmsse_final", sql(
    "SELECT round(CASE WHEN count(*) = count(wrmsse) THEN sum(wrmsse) END, 7) AS wrmsse, "
    "count(*) FILTER (WHERE wrmsse IS NULL) AS unscored_nodes FROM scored", "dsales", "wprices", **_daily_ctes()))
def wrmsse_final(s, r):
    view = ob.daily_view(s, r, staged=True)
    sales = view.sales()
    root, source = score_root(s, r)
    inputs = score.stored_inputs(sales, view.calendar(), view.weekly_prices(), D_CUT, 28, "lenient",
                                 root, f"daily {source}")
    scored = inputs.score(forecast.seasonal_naive(sales, D_CUT, 28, 28))
    return scoring.wrmsse(scored).withColumn("wrmsse", F.round("wrmsse", 7))


# -- per-series statistics ----------------------------------------------------------

query("f11_series_mean", sql(
    "SELECT id, round(avg(sales), 6) AS mean FROM sales GROUP BY id", "sales"))(
    lambda s, r: series.series_mean(ob.monthly_sales(s, r)).withColumn("mean", F.round("mean", 6)))
query("f12_row_count", sql(
    "SELECT item_id, store_id, count(*) AS n FROM cells GROUP BY ALL", "cells"))(
    lambda s, r: series.row_count(ob.monthly_cells(s, r)))


@query("f13_latest_row", sql(
    "SELECT item_id, store_id, max(d) AS d, arg_max(sales, d) AS sales FROM cells GROUP BY ALL", "cells"))
def latest_row(s, r):
    return series.latest_row(ob.monthly_cells(s, r)).select("item_id", "store_id", "d", "sales")


query("f14_distinct", sql("SELECT DISTINCT o_custkey, o_orderpriority FROM orders"))(
    lambda s, r: s.read.parquet(f"{r}/orders.parquet").select("o_custkey", "o_orderpriority").distinct())


@query("f15_ensemble_mean", sql(f"""
SELECT id, CAST(h AS INT) AS h, (last + season[h]) / 2 AS yhat FROM (
  SELECT id, max(sales) FILTER (WHERE d = {CUTOFF}) AS last,
         list(sales ORDER BY d) FILTER (WHERE d BETWEEN {CUTOFF} - 11 AND {CUTOFF} - 12 + {H}) AS season
  FROM sales GROUP BY id) CROSS JOIN range(1, {H + 1}) g(h)""", "sales"))
def ensemble_mean(s, r):
    sales = ob.monthly_view(s, r, staged=True).sales()
    return series.ensemble_mean([forecast.naive(sales, CUTOFF, H), forecast.seasonal_naive(sales, CUTOFF, H, 12)])


@query("f16_rmse", sql(
    "SELECT round(sqrt(avg((sales - p) * (sales - p))), 6) AS rmse FROM (SELECT sales, lag(sales) OVER "
    "(PARTITION BY id ORDER BY d) AS p FROM sales)", "sales"))
def rmse(s, r):
    rows = lags.add_lags(ob.monthly_sales(s, r), 1)
    return scoring.rmse(rows, "sales", "lag1").withColumn("rmse", F.round("rmse", 6))


_DEMAND = """
SELECT id, count(*) FILTER (WHERE sales > 0) AS n_demands,
       CAST(max(d) FILTER (WHERE sales > 0) - min(d) + 1 AS DOUBLE) / nullif(count(*) FILTER (WHERE sales > 0), 0) AS adi,
       (squares - total * total / n) / nullif(n - 1, 0) / nullif((total / n) * (total / n), 0) AS cv2
FROM (SELECT id, d, sales, count(*) FILTER (WHERE sales > 0) OVER w AS n, sum(sales) FILTER (WHERE sales > 0) OVER w AS total,
             sum(sales * sales) FILTER (WHERE sales > 0) OVER w AS squares FROM sales WINDOW w AS (PARTITION BY id))
GROUP BY id, n, total, squares"""

query("f17_demand_stats", sql(
    "SELECT id, n_demands, round(adi, 6) AS adi, round(cv2, 9) AS cv2 FROM dem", "sales", dem=_DEMAND))(
    lambda s, r: series.demand_stats(ob.monthly_sales(s, r)).select(
        "id", "n_demands", F.round("adi", 6).alias("adi"), F.round("cv2", 9).alias("cv2")))

# -- lags ---------------------------------------------------------------------------

query("g1_add_lags", sql("SELECT id, d, sales, " + ", ".join(
    f"lag(sales, {k}) OVER (PARTITION BY id ORDER BY d) AS lag{k}" for k in range(1, 11)) + " FROM dsales", "dsales"))(
    lambda s, r: lags.add_lags(ob.daily_sales(s, r).select("id", "d", "sales"), 10))


@query("g2_embed", sql("SELECT * FROM (SELECT id, d, sales AS y, " + ", ".join(
    f"lag(sales, {k}) OVER (PARTITION BY id ORDER BY d) AS lag{k}" for k in (1, 2, 28, 400))
    + " FROM dsales) WHERE lag400 IS NOT NULL", "dsales"))
def embed(s, r):
    rows = lags.embed(ob.daily_sales(s, r), 400)
    return rows.select("id", "d", "y", *[F.element_at("lags", k).alias(f"lag{k}") for k in (1, 2, 28, 400)])


@query("g3_latest_lags", sql(
    "SELECT id, string_agg(CAST(CAST(sales AS BIGINT) AS VARCHAR), ',' ORDER BY d DESC) AS lags "
    "FROM sales WHERE d > (SELECT max(d) FROM sales) - 10 GROUP BY id", "sales"))
def latest_lags(s, r):
    rows = lags.latest_lags(ob.monthly_sales(s, r), 10)
    texts = F.transform("lags", lambda x: x.cast("bigint").cast("string"))
    return rows.select("id", F.array_join(texts, ",").alias("lags"))


query("g4_first_difference", sql(
    "SELECT id, d, sales - lag(sales) OVER (PARTITION BY id ORDER BY d) AS diff FROM sales", "sales"))(
    lambda s, r: lags.first_difference(ob.monthly_sales(s, r)).select("id", "d", "diff"))
query("g5_cumulative_count", sql(
    "SELECT id, d, CAST(row_number() OVER (PARTITION BY id ORDER BY d) AS INT) AS n FROM cells", "cells"))(
    lambda s, r: lags.cumulative_count(ob.monthly_cells(s, r)).select("id", "d", "n"))


@query("g6_push_lag", sql(
    "SELECT id, avg7 AS lag1, l1 AS lag2, l2 AS lag3 FROM (SELECT id, round(avg(sales), 6) AS avg7, "
    "max(CASE WHEN d = m THEN sales END) AS l1, max(CASE WHEN d = m - 1 THEN sales END) AS l2 "
    "FROM sales, (SELECT max(d) AS m FROM sales) GROUP BY id)", "sales"))
def push_lag(s, r):
    from tallycast.functions.arrays import push_lag as push

    series_rows = lags.series_arrays(ob.monthly_sales(s, r))
    newest = F.slice(F.reverse("ys"), 1, 3)
    pushed = series_rows.select("id", push(newest, F.round("mean", 6), 3).alias("p"))
    return pushed.select("id", *[F.element_at("p", k).alias(f"lag{k}") for k in (1, 2, 3)])


@query("g7_forecast_origin", sql(
    "SELECT id, 70 AS origin, max(CASE WHEN d = 70 THEN sales END) AS lag1, "
    "max(CASE WHEN d = 61 THEN sales END) AS lag10 FROM sales GROUP BY id", "sales"))
def forecast_origin(s, r):
    rows = lags.forecast_origin(ob.monthly_sales(s, r), 70, 10)
    return rows.select("id", "origin", F.element_at("lags", 1).alias("lag1"), F.element_at("lags", 10).alias("lag10"))


# -- order, sample, stack -----------------------------------------------------------


@query("h1_order_by_id", sql(
    "SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS position FROM (SELECT DISTINCT id FROM cells)", "cells"))
def order_by_id(s, r):
    return ordering.with_position(ob.monthly_cells(s, r).select("id").distinct(), [F.col("id")])


@query("h2_canonical_order", sql("""
SELECT item_id || '_' || store_id || '_' || stage AS id,
  row_number() OVER (ORDER BY CASE stage WHEN 'validation' THEN 1 ELSE 2 END, split_part(store_id, '_', 1), store_id,
  CASE split_part(item_id, '_', 1) WHEN 'HOBBIES' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 3 END, item_id) AS position
FROM names CROSS JOIN (VALUES ('validation'), ('evaluation')) v(stage)""", names=_OUT_IDS))
def canonical_order(s, r):
    return ordering.with_position(assemble.replicate_stage(make_id(s, r)), ordering.canonical_keys())


_SAMPLED = "(SELECT id, d, row_number() OVER (ORDER BY md5('777|' || id || '_' || d), id || '_' || d) AS k FROM cells)"


def _holdout(s, r):
    rows = ob.monthly_view(s, r, staged=True).priced_cells().select("id", "d", "sales")
    return rows, sampling.holdout(rows, 2000, 777, ["id", "d"])


query("h3_holdout_sample", sql(f"SELECT id, d FROM {_SAMPLED} WHERE k <= 2000", "cells"))(
    lambda s, r: _holdout(s, r)[1][0].select("id", "d"))


@query("h4_complement", sql(f"SELECT id, d FROM {_SAMPLED} WHERE k > 2000", "cells"))
def complement(s, r):
    rows, (sample, _) = _holdout(s, r)
    return sampling.complement(rows, sample, ["id", "d"]).select("id", "d")


@query("h5_stack", sql(
    "SELECT 'validation' AS stage, id, d, sales FROM sales WHERE d BETWEEN 50 AND 77 UNION ALL "
    "SELECT 'evaluation', id, d, sales FROM sales WHERE d > (SELECT max(d) FROM sales) - 28", "sales"))
def stack(s, r):
    view = ob.monthly_view(s, r, staged=True)
    sales = view.sales().select("id", "d", "sales")
    parts = {"validation": filters.last_n(sales, 77), "evaluation": filters.last_n(sales, view.last)}
    tagged = [df.withColumn("stage", F.lit(n)) for n, df in parts.items()]
    return tagged[0].unionByName(tagged[1])


query("h6_replicate_stage", sql(
    "SELECT item_id || '_' || store_id || st AS id FROM names CROSS JOIN (VALUES ('_validation'), ('_evaluation')) v(st)",
    names=_OUT_IDS))(lambda s, r: assemble.replicate_stage(make_id(s, r)))


@query("h7_stack_levels", sql(
    "SELECT store_id AS name, sum(sales) AS sales, CAST(NULL AS BIGINT) AS n FROM cells GROUP BY store_id UNION ALL "
    "SELECT item_id, NULL, count(*) FROM cells GROUP BY item_id", "cells"))
def stack_levels(s, r):
    cells = ob.monthly_cells(s, r)
    stores = cells.groupBy(F.col("store_id").alias("name")).agg(F.sum("sales").alias("sales"))
    items = cells.groupBy(F.col("item_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return stores.unionByName(items, allowMissingColumns=True)


