"""Sources and sinks: tables derived from the order book are written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.measures import (
    CUTOFF, FORECASTS, H, _MASKED, _SHARES, _TRAIN_NODES, _WEIGHTS, _revenue, _score_ctes,
)
from catalog.models import (
    ONE_STEP, _CLUSTERS, _FLAGGED, _LAGGED, _NORMAL, _TWO_LAGS, _cluster_rows, _flag_rows,
)
from catalog.registry import query, sql
from catalog.shape import month_labels, wide_monthly
from tallycast.functions.ids import day_label, horizon_label
from tallycast.models import boost, ols
from tallycast.models.design import Design
from tallycast.operators import ordering, scoring, series
from tallycast.operators.intermittent import VARIANTS, croston
from tallycast.operators.reshape import to_wide
from tallycast.plans import score
from tallycast.session import scratch_path
from tallycast.sources import orderbook as ob
from tallycast.sources import readers, writers


@query("a1_read_sales", sql("SELECT id, state_id, d, sales FROM sales", "sales"))
def read_sales(s, r):
    path = scratch_path(s, "sales")
    writers.write_table(wide_monthly(s, r), path)
    return readers.read_sales(s, path, 1, ob.n_months(s, r), keys=["id", "state_id"])


def numbered_ids(s, r):
    """(series_no, id): the explicit key of the positional files."""
    distinct = ob.monthly_cells(s, r).select("id").distinct()
    return ordering.with_position(distinct, [F.col("id")]) \
        .select(F.col("position").cast("int").alias("series_no"), "id")


def _matrix(s, wide, columns, label):
    """Write one headerless line per series, in series order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    path = scratch_path(s, label)
    wide.orderBy("series_no").select(F.concat_ws(",", *cells).alias("value")).write.text(path)
    return path


def _series_matrix(s, r, table, value):
    ids = numbered_ids(s, r)
    labelled = table.join(ids, "id").withColumn("label", day_label("d"))
    columns = month_labels(s, r)
    wide = to_wide(labelled, ["series_no"], "label", value, columns)
    return _matrix(s, wide, columns, value), ids


@query("a2_read_series_matrix", sql("SELECT id, d, sales FROM sales", "sales"))
def read_series_matrix(s, r):
    path, ids = _series_matrix(s, r, ob.monthly_sales(s, r), "sales")
    return readers.read_series_matrix(s, path, ids).select("id", "d", "sales")


@query("a3_read_calendar", sql(
    "SELECT * FROM calendar WHERE date IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)", "calendar"))
def read_calendar(s, r):
    path = scratch_path(s, "calendar")
    # the days on which something was shipped
    shipped = s.read.parquet(f"{r}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date")).distinct()
    cal = ob.daily_calendar(s, r).join(shipped, "date", "left_semi")
    order = ["date", "wm_yr_wk", "weekday", "wday", "month", "year", "d", "event_name_1",
             "event_type_1", "event_name_2", "event_type_2", *[f"snap_{x}" for x in ob.STATES]]
    writers.write_table(cal.withColumn("d", day_label("d")).select(*[F.col(f"`{c}`") for c in order]), path)
    return readers.read_calendar(s, path, ob.STATES)


@query("a4_read_prices", sql(
    "SELECT store_id, item_id, d AS wm_yr_wk, sell_price FROM cells", "cells"))
def read_prices(s, r):
    path = scratch_path(s, "prices")
    writers.write_table(ob.monthly_prices(s, r), path)
    return readers.read_prices(s, path)


@query("a5_read_price_matrix", sql(
    "SELECT id, d, sell_price AS price FROM sales WHERE d <= (SELECT max(d) FROM sales) - 28", "sales"))
def read_price_matrix(s, r):
    path, ids = _series_matrix(s, r, ob.monthly_cells(s, r), "sell_price")
    return readers.read_price_matrix(s, path, ids, drop_last=28)


@query("a6_read_clusters", sql("""
SELECT CAST(dense_rank() OVER (ORDER BY cat_id) AS INT) AS cluster_id,
       CAST(row_number() OVER (ORDER BY id) AS INT) AS series_no
FROM (SELECT DISTINCT id, cat_id FROM cells)""", "cells"))
def read_clusters(s, r):
    cats = ob.monthly_cells(s, r).select("id", "cat_id").distinct()
    members = numbered_ids(s, r).join(cats, "id")
    numbers = F.transform(F.sort_array(F.collect_list(F.col("series_no") - 1)), lambda x: x.cast("string"))
    path = scratch_path(s, "clusters")
    members.groupBy("cat_id").agg(F.array_join(numbers, " ").alias("value")) \
        .orderBy("cat_id").select("value").write.text(path)
    return readers.read_clusters(s, path)


PERIODS = {"first": 65, "second": 71, "third": CUTOFF}


@query("a7_load_score_inputs", "\nUNION ALL\n".join(
    f"SELECT '{p}' AS period, * FROM (" + sql(f"""
SELECT 'actual' AS part, count(*) AS n, round(sum(sales), 4) AS total FROM sales WHERE d BETWEEN {c} + 1 AND {c} + {H}
UNION ALL SELECT 'weights', count(*), round(sum(weight), 4) FROM w
UNION ALL SELECT 'training_nodes', count(*), round(sum(value), 4) FROM train_nodes""", "sales",
        train=_MASKED + f" WHERE d <= {c}", train_nodes=_TRAIN_NODES,
        rev=_revenue("lenient", c), shares=_SHARES, w=_WEIGHTS) + ")"
    for p, c in PERIODS.items()))
def load_score_inputs(s, r):
    """Three periods are stored side by side, each is loaded for itself."""
    root, view = scratch_path(s, "score"), ob.monthly_view(s, r, staged=True)
    sales, cal, prices = view.sales(), view.calendar(), view.prices()
    for period, c in PERIODS.items():
        writers.write_score_inputs(
            root, period,
            weights=scoring.weights12(scoring.series_revenue(sales, cal, prices, c, H, "lenient")),
            actual=score.actual_horizon(sales.where(F.col("d").between(c + 1, c + H)), c),
            training_nodes=score.train_hierarchy(sales.where(F.col("d") <= c), cal, prices),
        )
    values = {"actual": "sales", "weights": "weight", "training_nodes": "value"}
    parts = []
    for period in PERIODS:
        loaded = readers.load_score_inputs(s, root, period)
        parts += [
            loaded[name].agg(F.lit(period).alias("period"), F.lit(name).alias("part"),
                             F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"))
            for name, v in values.items()
        ]
    return reduce(DataFrame.unionByName, parts)


def _wide_file(s, fc, label):
    """A forecast as a wide CSV, read back."""
    path = scratch_path(s, label)
    labelled = fc.withColumn("label", horizon_label("h"))
    writers.write_table(to_wide(labelled, ["id"], "label", "yhat", [f"F{h}" for h in range(1, H + 1)]), path)
    return readers.read_forecasts(s, path, H)


@query("a12_read_forecasts", sql(FORECASTS["seasonal"][1].format(c=CUTOFF, h=H), "sales"))
def read_forecasts(s, r):
    sales = ob.monthly_view(s, r, staged=True).sales()
    return _wide_file(s, FORECASTS["seasonal"][0](sales, CUTOFF, H), "forecast")


@query("f15_ensemble_from_files", sql(f"""
SELECT id, h, avg(yhat) AS yhat FROM ({FORECASTS["seasonal"][1].format(c=CUTOFF, h=H)}
UNION ALL {FORECASTS["naive"][1].format(c=CUTOFF, h=H)}) GROUP BY id, h""", "sales"))
def ensemble_from_files(s, r):
    sales = ob.monthly_view(s, r, staged=True).sales()
    files = [_wide_file(s, FORECASTS[k][0](sales, CUTOFF, H), k) for k in ("naive", "seasonal")]
    return series.ensemble_mean(files)


@query("f10_wrmsse_from_files", sql(
    "SELECT level_id, name, round(rmsse, 6) AS rmsse, round(wrmsse, 9) AS wrmsse FROM scored",
    "sales", **_score_ctes("seasonal")))
def wrmsse_from_files(s, r):
    view = ob.monthly_view(s, r, staged=True)
    sales = view.sales()
    fc = _wide_file(s, FORECASTS["seasonal"][0](sales, CUTOFF, H), "forecast")
    scored = score.score_forecasts(fc, sales, view.calendar(), view.prices(), CUTOFF, H, "lenient")
    return scored.select("level_id", "name", F.round("rmsse", 6).alias("rmsse"), F.round("wrmsse", 9).alias("wrmsse"))


@query("a8_write_table", sql("SELECT id, d, sales FROM cells", "cells"))
def write_table(s, r):
    path = scratch_path(s, "table")
    cells = ob.monthly_cells(s, r).select("id", "d", "sales")
    writers.write_table(cells.where("d < 10"), path)
    writers.write_table(cells, path)  # overwrites
    return s.read.schema("id string, d int, sales double").csv(path, header=True)


@query("a9_write_by_cluster", sql("SELECT cat_id, id, d, sales FROM cells", "cells"))
def write_by_cluster(s, r):
    path = scratch_path(s, "by-cluster")
    cells = ob.monthly_cells(s, r).select("cat_id", "id", "d", "sales")
    writers.write_forecasts(cells.withColumn("sales", F.lit(0.0)), path, by="cat_id")
    for part in (F.col("cat_id") < "M", F.col("cat_id") >= "M"):  # each replaces its partitions
        writers.write_forecasts(cells.where(part), path, by="cat_id")
    return s.read.parquet(path)


@query("a9_resumed_output", sql(
    "SELECT cat_id, id, d, sales, CASE WHEN dense_rank() OVER (ORDER BY cat_id) <= 2 THEN 1 ELSE 2 END AS run FROM cells",
    "cells"))
def resumed_output(s, r):
    """A run that breaks off in its second job, and one that completes it; ``run`` tells who wrote a row."""
    path = scratch_path(s, "resumed")
    cells = ob.monthly_view(s, r, staged=True).priced_cells().select("cat_id", "id", "d", "sales")
    categories = sorted(x[0] for x in cells.select("cat_id").distinct().collect())
    calls = []

    def make(run):
        def rows(some):
            calls.append(some)
            if run == 1 and len(calls) == 2:
                raise InterruptedError
            return cells.where(F.col("cat_id").isin(some)).withColumn("run", F.lit(run))
        return rows

    try:
        writers.write_missing(s, path, categories, make(1), by="cat_id", at_once=2)
    except InterruptedError:
        writers.write_missing(s, path, categories, make(2), by="cat_id", at_once=2)
    return s.read.parquet(path)


@query("a10_write_by_model", sql(
    "SELECT v.model, id, CAST(h.h AS INT) AS h FROM (SELECT DISTINCT id FROM cells) "
    f"CROSS JOIN (VALUES ('croston'), ('sba'), ('sbj')) v(model) CROSS JOIN range(1, {H + 1}) h(h)", "cells"))
def write_by_model(s, r):
    path = scratch_path(s, "by-model")
    sales = ob.monthly_view(s, r, staged=True).sales()
    for v in VARIANTS:
        writers.write_forecasts(croston(sales, H, 0.1, v).withColumn("model", F.lit(v)), path, by="model")
    return s.read.parquet(path).select("model", "id", "h")


@query("a11_save_model", sql(
    "SELECT cluster_id, round(beta1, 7) AS beta1, round(beta2, 7) AS beta2 FROM b",
    "dsales", normal=_NORMAL, lagged=_LAGGED, clusters=_CLUSTERS, b=_TWO_LAGS))
def save_model(s, r):
    path = scratch_path(s, "model")
    writers.write_table(ols.fit_ols(_cluster_rows(s, r, 2), Design(2), "cluster_id"), path, "parquet")
    beta = [F.round(F.element_at("lag_beta", k), 7).alias(f"beta{k}") for k in (1, 2)]
    return s.read.parquet(path).select("cluster_id", *beta)


@query("a11_save_booster", sql("""
SELECT g AS weekday_flag, round(exp(ln(mu) + 0.5 * sum(y - mu) / (sum(mu) + 0.1)), 6) AS mean
FROM flagged CROSS JOIN (SELECT avg(y) AS mu FROM flagged) GROUP BY g, mu""",
    "dsales", "externals", flagged=_FLAGGED))
def save_booster(s, r):
    """The fitted trees are stored, loaded and used."""
    path = scratch_path(s, "booster")
    rows, design = _flag_rows(s, r)
    boost.save_boosted(boost.fit_boosted_poisson(rows, design, ONE_STEP), s, path)
    return boost.predict_boosted(rows.select("weekday_flag").distinct(), boost.load_boosted(s, path)) \
        .select("weekday_flag", F.round("prediction", 6).alias("mean"))
