"""Models, recursive forecasts, intermittent demand and output assembly."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.measures import _DEMAND, _MASKED, _EXTERNALS, CUTOFF, EXTERNALS, H
from catalog.registry import lenient_sum, levels_sql, query, sql, strict_sum
from catalog.shape import LAST, output_lines
from tallycast.functions.arrays import dot
from tallycast.models import boost, ols, poisson, recursion
from tallycast.models.design import Design, default_design
from tallycast.operators import intermittent, lags, sampling, series
from tallycast.plans import assemble, evaluate, forecast, score
from tallycast.session import scratch_path, stage
from tallycast.sources import orderbook as ob

HOLDOUT_ROWS = 10_000
LAGS = 400

# -- normalisation and frames -------------------------------------------------------

query("m1_normalize", sql(
    "SELECT id, d, round(sales / nullif(avg(sales) OVER (PARTITION BY id), 0), 9) AS sales FROM sales", "sales"))(
    lambda s, r: series.normalize(ob.monthly_sales(s, r)).select("id", "d", F.round("sales", 9).alias("sales")))


@query("m1_denormalize", sql(
    f"SELECT id, 1 AS h, round(sales, 6) AS yhat FROM sales WHERE d = {LAST}", "sales"))
def denormalize(s, r):
    view = ob.monthly_view(s, r, staged=True)
    scaled = series.normalize(view.sales()).where(F.col("d") == view.last) \
        .select("id", F.lit(1).alias("h"), F.col("sales").alias("yhat"))
    means = series.series_mean(view.sales())
    return series.denormalize(scaled, means).withColumn("yhat", F.round("yhat", 6))


_NORMAL = ("SELECT id, item_id, dept_id, cat_id, store_id, state_id, d, "
           "sales / nullif(avg(sales) OVER (PARTITION BY id), 0) AS y FROM dsales")
_LAGGED = ("SELECT *, " + ", ".join(f"lag(y, {k}) OVER (PARTITION BY id ORDER BY d) AS lag{k}" for k in (1, 2, 28, 56, 400))
           + " FROM normal")
_CLUSTERS = ("SELECT cat_id, CAST(row_number() OVER (ORDER BY cat_id) AS INT) AS cluster_id "
             "FROM (SELECT DISTINCT cat_id FROM dsales)")


@query("m2_training_matrix", sql(f"""
SELECT t.id, k.cluster_id, t.d, round(t.y, 9) AS y, round(t.lag1, 9) AS lag1, round(t.lag400, 9) AS lag400, {_EXTERNALS}
FROM lagged t JOIN clusters k USING (cat_id) JOIN externals e ON e.d = t.d AND e.state_id = t.state_id
WHERE t.lag400 IS NOT NULL""", "dsales", "externals", normal=_NORMAL, lagged=_LAGGED, clusters=_CLUSTERS))
def training_matrix(s, r):
    view = ob.daily_view(s, r, staged=True)
    rows = lags.training_matrix(view.sales(), view.calendar(), LAGS, view.clusters())
    return rows.select("id", "cluster_id", "d", F.round("y", 9).alias("y"),
                       F.round(F.element_at("lags", 1), 9).alias("lag1"),
                       F.round(F.element_at("lags", LAGS), 9).alias("lag400"), *EXTERNALS)


@query("m3_test_frame", sql(f"""
SELECT t.id, CAST(e.d - t.d AS INT) AS h, e.d, round(t.y, 9) AS lag1, round(t.lag2, 9) AS lag3, {_EXTERNALS}
FROM lagged t JOIN externals e ON e.state_id = t.state_id AND e.d > t.d
WHERE t.d = (SELECT max(d) FROM dsales)""", "dsales", "externals", normal=_NORMAL, lagged=_LAGGED))
def test_frame(s, r):
    frame = lags.test_frame(ob.daily_sales(s, r), ob.daily_calendar(s, r), 10, 28)
    return frame.select("id", "h", "d", F.round(F.element_at("lags", 1), 9).alias("lag1"),
                        F.round(F.element_at("lags", 3), 9).alias("lag3"), *EXTERNALS)


# -- least squares ------------------------------------------------------------------


def _cluster_rows(s, r, n):
    view = ob.daily_view(s, r, staged=True)
    series_rows = lags.prepare_series(view.sales(), view.clusters())
    return lags.embed_arrays(series_rows, n)


_TWO_LAGS = """
SELECT cluster_id, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS beta1,
       (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS beta2
FROM (SELECT k.cluster_id, sum(lag1 * lag1) AS a11, sum(lag1 * lag2) AS a12, sum(lag2 * lag2) AS a22,
             sum(lag1 * y) AS b1, sum(lag2 * y) AS b2
      FROM lagged JOIN clusters k USING (cat_id) WHERE lag2 IS NOT NULL GROUP BY k.cluster_id)"""


@query("m4_gram", sql("""
SELECT CAST(k.cluster_id AS VARCHAR) AS cluster, round(sum(lag1 * lag1), 5) AS g11,
       round(sum(lag1 * lag2), 5) AS g12, round(sum(lag2 * y), 5) AS g2y, round(sum(y * y), 5) AS gyy
FROM lagged JOIN clusters k USING (cat_id) WHERE lag2 IS NOT NULL GROUP BY k.cluster_id""",
    "dsales", normal=_NORMAL, lagged=_LAGGED, clusters=_CLUSTERS))
def gram(s, r):
    pieces = ols.gram(_cluster_rows(s, r, 2), Design(2), "cluster_id")
    at = lambda i, j: F.round(F.max(F.when(F.col("i") == i, F.element_at("row", j + 1))), 5)
    return pieces.groupBy(F.col("_g").alias("cluster")).agg(
        at(0, 0).alias("g11"), at(0, 1).alias("g12"), at(1, 2).alias("g2y"), at(2, 2).alias("gyy"))


@query("m4_cluster_ols_two_lags", sql(
    "SELECT cluster_id, round(beta1, 7) AS beta1, round(beta2, 7) AS beta2 FROM b",
    "dsales", normal=_NORMAL, lagged=_LAGGED, clusters=_CLUSTERS, b=_TWO_LAGS))
def cluster_ols_two_lags(s, r):
    fit = ols.fit_ols(_cluster_rows(s, r, 2), Design(2), "cluster_id")
    return fit.select("cluster_id", *[F.round(F.element_at("lag_beta", k), 7).alias(f"beta{k}") for k in (1, 2)])


@query("m4_m18_cluster_ols_forecast")
def cluster_ols(s, r):
    view = ob.daily_view(s, r, staged=True)
    return forecast.cluster_forecast(view.sales(), view.calendar(), view.clusters(), LAGS, 28)


_FACTORS = ["weekday_flag", "month", "snap", "wday", "day", "event_name_1", "event_name_2", "event_type_1", "event_type_2"]


def _moments_sql(source: str, y: str, factors: list[str], lag_names: list[str], group: str = "'all'") -> str:
    """Sums of ``y`` per factor level and of ``y`` times each lag: what a fit must reproduce."""
    parts = [f"SELECT CAST({group} AS VARCHAR) AS grp, '{f}=' || {f} AS term, sum({y}) AS moment FROM {source} GROUP BY 1, 2"
             for f in factors]
    parts += [f"SELECT CAST({group} AS VARCHAR) AS grp, '{c}' AS term, sum({y} * {c}) AS moment FROM {source} GROUP BY 1"
              for c in lag_names]
    return " UNION ALL ".join(parts)


def _moments(rows, fitted, factors, lag_numbers, group=None, digits=3):
    """The same from fitted values: a solution of the normal or score equations agrees."""
    terms = [F.struct(F.concat(F.lit(f"{f}="), F.col(f).cast("string")).alias("term"), fitted.alias("v")) for f in factors]
    terms += [F.struct(F.lit(f"lag{k}").alias("term"), (fitted * F.element_at("lags", k)).alias("v")) for k in lag_numbers]
    grp = F.col(group).cast("string") if group else F.lit("all")
    return rows.select(grp.alias("grp"), F.explode(F.array(*terms)).alias("t")).groupBy("grp", "t.term").agg(
        F.round(F.sum("t.v"), digits).alias("moment"))


@query("m4_normal_equations", sql(
    "SELECT grp, term, round(moment, 3) AS moment FROM moments", "dsales", "externals",
    normal=_NORMAL, lagged=_LAGGED, clusters=_CLUSTERS,
    complete="SELECT t.y, t.lag1, t.lag28, t.lag400, k.cluster_id, e.* FROM lagged t JOIN clusters k USING (cat_id) "
         "JOIN externals e ON e.d = t.d AND e.state_id = t.state_id WHERE t.lag400 IS NOT NULL",
    moments=_moments_sql("complete", "y", _FACTORS, ["lag1", "lag28", "lag400"], "cluster_id")))
def normal_equations(s, r):
    """400 lags and all factors by cluster: X'yhat = X'y."""
    view = ob.daily_view(s, r, staged=True)
    rows = lags.training_matrix(view.sales(), view.calendar(), LAGS, view.clusters())
    design = default_design(view.calendar(), LAGS)
    fits = stage(ols.fit_ols(rows, design, "cluster_id").drop("n_rows"), "fits")
    fitted = dot(F.col("lags"), F.col("lag_beta")) + design.external_effect(F.col("ext_beta"))
    joined = rows.join(fits, "cluster_id").withColumn("fitted", fitted)
    return _moments(joined, F.col("fitted"), _FACTORS, [1, 28, 400], "cluster_id")


@query("m18_every_series", sql("""
SELECT CASE WHEN k.cluster_id IS NULL THEN 'no cluster' WHEN h.n < 28 THEN 'short history' END AS reason,
       count(*) AS ids, 28 * count(*) AS steps,
       CAST(sum(CASE WHEN k.cluster_id IS NULL OR h.n < 28 THEN 0 ELSE 28 END) AS BIGINT) AS vals
FROM (SELECT id, any_value(cat_id) AS cat_id, count(*) AS n FROM dsales GROUP BY id) h
LEFT JOIN clusters k USING (cat_id) GROUP BY 1""", "dsales", clusters=_CLUSTERS))
def every_series(s, r):
    """Series in, steps and values out, and the reason where values are missing."""
    view = ob.daily_view(s, r, staged=True)
    sales, members = view.sales(), view.clusters()
    fc = forecast.cluster_forecast(sales, view.calendar(), members, 28, 28)
    report = evaluate.coverage(sales, fc, 28, members)
    return report.groupBy("reason").agg(F.count("*").alias("ids"), F.sum("steps").alias("steps"),
                                        F.sum("values").alias("vals"))


@query("m5_linear_one_lag", sql(
    "SELECT round(regr_slope(y, lag1), 7) AS slope, round(regr_intercept(y, lag1), 7) AS intercept "
    "FROM lagged WHERE lag1 IS NOT NULL", "dsales", normal=_NORMAL, lagged=_LAGGED))
def linear_one_lag(s, r):
    rows = lags.embed_arrays(lags.prepare_series(ob.daily_sales(s, r)), 1)
    model = ols.fit_linear_regression(rows, Design(1, intercept=True, drop_first=True))
    fitted = [(round(float(model.coefficients[0]), 7), round(float(model.intercept), 7))]
    return s.createDataFrame(fitted, "slope double, intercept double")


@query("m5_global_linear_forecast")
def global_linear(s, r):
    view = ob.daily_view(s, r, staged=True)
    return forecast.global_linear_forecast(view.sales(), view.calendar(), view.weekly_prices(), 56, 28)


_LINEAR_TERMS = [*forecast.GLOBAL_FACTORS, "dept_id", "cat_id", "store_id", "state_id"]


@query("m5_normal_equations", sql(
    "SELECT grp, term, round(moment, 3) AS moment FROM moments", "dsales", "externals", "wprices",
    normal=_NORMAL, lagged=_LAGGED,
    complete="SELECT t.id, t.item_id, t.dept_id, t.cat_id, t.store_id, t.y, t.lag1, t.lag56, e.* FROM lagged t "
             "JOIN externals e ON e.d = t.d AND e.state_id = t.state_id JOIN wprices p ON p.store_id = t.store_id "
             "AND p.item_id = t.item_id AND p.wm_yr_wk = CAST(floor((t.d - 1) / 7) AS INT) WHERE t.lag56 IS NOT NULL",
    moments=_moments_sql("complete", "y", _LINEAR_TERMS, ["lag1", "lag56"])))
def linear_normal_equations(s, r):
    """56 lags, the weekly price and all factors: X'yhat = X'y."""
    view = ob.daily_view(s, r, staged=True)
    rows = lags.training_matrix(view.sales(), view.calendar(), 56, prices=view.weekly_prices())
    rows = stage(rows.dropna(subset=["sell_price"]), "training")
    design = default_design(view.calendar(), 56, statics=view.cells, numeric=("sell_price",),
                            static_factors=("dept_id", "cat_id", "store_id", "state_id"),
                            calendar_factors=forecast.GLOBAL_FACTORS, intercept=True, drop_first=True)
    design = ols.drop_aliased(rows, design)
    lag_beta, ext = ols.mllib_coefficients(ols.fit_linear_regression(rows, design), design)
    fitted = dot(F.col("lags"), F.array(*[F.lit(b) for b in lag_beta])) \
        + design.external_effect(recursion._map_literal(ext))
    return _moments(rows.withColumn("fitted", fitted), F.col("fitted"), _LINEAR_TERMS, [1, 56])


# -- Poisson ------------------------------------------------------------------------


def _category_rows(s, r):
    return ob.monthly_sales(s, r).select("cat_id", F.col("sales").alias("y"))


def _category_design(s, r):
    levels = sorted(x[0] for x in ob.monthly_cells(s, r).select("cat_id").distinct().collect())
    return Design(0, {"cat_id": levels}, intercept=True, drop_first=True)


@query("m6_poisson_category_means", sql(
    "SELECT cat_id, round(avg(sales), 3) AS mu FROM sales GROUP BY cat_id", "sales"))
def poisson_means(s, r):
    rows, design = _category_rows(s, r), _category_design(s, r)
    model = poisson.fit_poisson(rows, design)
    lag_beta, ext = ols.mllib_coefficients(model, design)
    eta = design.external_effect(recursion._map_literal(ext))
    return rows.select("cat_id").distinct().select("cat_id", F.round(F.exp(eta), 3).alias("mu"))


@query("m6_poisson_forecast")
def poisson_forecast(s, r):
    view = ob.daily_view(s, r, staged=True)
    return forecast.poisson_forecast(view.sales(), view.calendar(), view.daily_prices(), 10, 28)


# rows of the global models: ten lags, every day from launch on
_RAW = ("SELECT t.id, t.d, t.cat_id, t.state_id, CAST(t.sales AS DOUBLE) AS y, p.price, "
        "lag(t.sales, 1) OVER w AS lag1, lag(t.sales, 10) OVER w AS lag10 FROM dsales t "
        "LEFT JOIN dprices p ON p.id = t.id AND p.d = t.d WINDOW w AS (PARTITION BY t.id ORDER BY t.d)")
_RAW_FULL = ("SELECT w.*, e.* EXCLUDE (d, state_id) FROM raw w JOIN externals e ON e.d = w.d AND e.state_id = w.state_id "
             "WHERE w.lag10 IS NOT NULL AND w.price IS NOT NULL")
_POISSON_TERMS = [*forecast.POISSON_FACTORS, *forecast.STATIC_FACTORS]


def _global_rows(s, r):
    view = ob.daily_view(s, r, staged=True)
    rows = forecast.training_rows(view.sales(), view.calendar(), view.daily_prices(), 10)
    return view, stage(rows, "training")


@query("m6_m7_m8_training_rows", sql(
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE y = 0) AS zeros, round(avg(y), 6) AS mean FROM complete",
    "dsales", "externals", "dprices", raw=_RAW, complete=_RAW_FULL))
def global_training_rows(s, r):
    """What the Poisson, zero-inflated and boosted routes are fitted on: days without sales too."""
    _, rows = _global_rows(s, r)
    return rows.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("y") == 0, 1)).alias("zeros"),
                    F.round(F.avg("y"), 6).alias("mean"))


@query("m6_score_equations", sql(
    "SELECT grp, term, round(moment, 0) AS moment FROM moments", "dsales", "externals", "dprices",
    raw=_RAW, complete=_RAW_FULL, moments=_moments_sql("complete", "y", _POISSON_TERMS, ["lag1", "lag10"])))
def score_equations(s, r):
    """The canonical link makes fitted sums equal actual ones for every column of the design."""
    view, rows = _global_rows(s, r)
    design = default_design(view.calendar(), 10, statics=view.cells, static_factors=forecast.STATIC_FACTORS,
                            numeric=("price",), calendar_factors=forecast.POISSON_FACTORS,
                            intercept=True, drop_first=True)
    design = ols.drop_aliased(rows, design)
    lag_beta, ext = ols.mllib_coefficients(poisson.fit_poisson(rows, design), design)
    beta = F.array(*[F.lit(b) for b in lag_beta])
    fitted = F.exp(dot(F.col("lags"), beta) + design.external_effect(recursion._map_literal(ext)))
    return _moments(rows.withColumn("fitted", fitted), F.col("fitted"), _POISSON_TERMS, [1, 10], digits=0)


@query("m7_zip_by_category", sql("""
SELECT cat_id, round(lam, 4) AS lam, round(1 - mean / lam, 5) AS pi
FROM (SELECT cat_id, mean, lam FROM it WHERE k = 60)""", "sales", recursive=True,
    st="SELECT cat_id, avg(sales) AS mean, avg(sales) FILTER (WHERE sales > 0) AS pos FROM sales GROUP BY cat_id",
    it="SELECT cat_id, mean, pos, pos AS lam, 0 AS k FROM st UNION ALL "
       "SELECT cat_id, mean, pos, pos * (1 - exp(-lam)), k + 1 FROM it WHERE k < 60"))
def zip_by_category(s, r):
    rows, design = _category_rows(s, r), _category_design(s, r)
    model = poisson.fit_zip(rows, design, design, tol=1e-12)
    (_, count), (_, zero) = model.count_coefficients(), model.zero_coefficients()
    lam = F.exp(design.external_effect(recursion._map_literal(count)))
    pi = 1 / (1 + F.exp(-design.external_effect(recursion._map_literal(zero))))
    return rows.select("cat_id").distinct().select(
        "cat_id", F.round(lam, 4).alias("lam"), F.round(pi, 5).alias("pi"))


@query("m7_zip_forecast")
def zip_forecast(s, r):
    view = ob.daily_view(s, r, staged=True)
    return forecast.poisson_forecast(view.sales(), view.calendar(), view.daily_prices(), 10, 28,
                                     zero_inflated=True)


@query("m7_score_equations", sql(
    "SELECT part, term, round(moment, 0) AS moment FROM (SELECT 'count' AS part, term, moment FROM moments "
    "UNION ALL SELECT 'zero', term, 0.0 FROM zeros)", "dsales", "externals", "dprices",
    raw=_RAW, complete=_RAW_FULL, moments=_moments_sql("complete", "y", _POISSON_TERMS, ["lag1", "lag10", "price"]),
    zeros=_moments_sql("complete", "0", [*forecast.ZERO_FACTORS], ["lag1", "lag10", "price"])))
def zip_score_equations(s, r):
    """Both parts, all predictors: the count part reproduces the actual sums, weighted by the chance
    that a day is not a structural zero; in the zero part expected and fitted zeros cancel."""
    view, rows = _global_rows(s, r)
    shared = dict(numeric=("price",), intercept=True, drop_first=True)
    design = ols.drop_aliased(rows, default_design(
        view.calendar(), 10, statics=view.cells, static_factors=forecast.STATIC_FACTORS,
        calendar_factors=forecast.POISSON_FACTORS, **shared))
    zero = ols.drop_aliased(rows, default_design(view.calendar(), 10, calendar_factors=forecast.ZERO_FACTORS, **shared))
    model = poisson.fit_zip(rows, design, zero, tol=1e-14)

    def predictor(coefficients, layout):
        lag_beta, ext = coefficients
        return recursion.bounded(dot(F.col("lags"), F.array(*[F.lit(b) for b in lag_beta]))
                                 + layout.external_effect(recursion._map_literal(ext)))

    lam = F.exp(predictor(model.count_coefficients(), design))
    pi = 1 / (1 + F.exp(-predictor(model.zero_coefficients(), zero)))
    hidden = F.when(F.col("y") == 0, F.col("pi") / (F.col("pi") + (1 - F.col("pi")) * F.exp(-F.col("lam")))).otherwise(0.0)
    fitted = rows.withColumn("lam", lam).withColumn("pi", pi).withColumn("hidden", hidden)
    parts = {"count": ((1 - F.col("hidden")) * F.col("lam"), _POISSON_TERMS),
             "zero": (F.col("hidden") - F.col("pi"), list(forecast.ZERO_FACTORS))}
    sums = []
    for part, (value, factors) in parts.items():
        priced = fitted.withColumn("lags", F.concat("lags", F.array("price")))
        found = _moments(priced, value, factors, [1, 10, 11], digits=0).replace("lag11", "price", ["term"])
        sums.append(found.select(F.lit(part).alias("part"), "term", (F.col("moment") + 0.0).alias("moment")))
    return sums[0].unionByName(sums[1])


# -- boosting -----------------------------------------------------------------------

# One full step on one two-level factor has a closed form per leaf.
ONE_STEP = boost.BoostParams(learning_rate=0.5, num_leaves=2, rounds=1, row_sample=1.0, checkpoint_every=1)
_FLAGGED = ("SELECT s.cat_id, s.sales AS y, e.weekday_flag AS g FROM dsales s "
            "JOIN externals e ON e.d = s.d AND e.state_id = s.state_id")


def _flag_rows(s, r):
    from tallycast.operators.joins import external_vars

    view = ob.daily_view(s, r, staged=True)
    sales, cal = view.sales(), view.calendar()
    return external_vars(sales, cal).withColumnRenamed("sales", "y"), \
        default_design(cal, 0, calendar_factors=("weekday_flag",))


@query("m8_boost_one_step", sql("""
SELECT g AS weekday_flag, round(exp(ln(mu) + 0.5 * sum(y - mu) / (sum(mu) + 0.1)), 6) AS mean
FROM flagged CROSS JOIN (SELECT avg(y) AS mu FROM flagged) GROUP BY g, mu""",
    "dsales", "externals", flagged=_FLAGGED))
def boost_one_step(s, r):
    rows, design = _flag_rows(s, r)
    model = boost.fit_boosted_poisson(rows, design, ONE_STEP)
    return boost.predict_boosted(rows.select("weekday_flag").distinct(), model) \
        .select("weekday_flag", F.round("prediction", 6).alias("mean"))


@query("m9_boost_one_step_by_cluster", sql("""
SELECT cat_id, g AS weekday_flag, round(exp(ln(mu) + 0.5 * sum(y - mu) / (sum(mu) + 0.1)), 6) AS mean
FROM flagged JOIN (SELECT cat_id, avg(y) AS mu FROM flagged GROUP BY cat_id) USING (cat_id)
GROUP BY cat_id, g, mu""", "dsales", "externals", flagged=_FLAGGED))
def boost_by_cluster(s, r):
    rows, design = _flag_rows(s, r)
    models = boost.fit_boosted_by_cluster(rows, design, "cat_id", ONE_STEP)
    cells = rows.select("cat_id", "weekday_flag").distinct()
    parts = [boost.predict_boosted(cells.where(F.col("cat_id") == c), m) for c, m in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("cat_id", "weekday_flag", F.round("prediction", 6).alias("mean"))


@query("m8_m10_global_boost_forecast")
def global_boost(s, r):
    view = ob.daily_view(s, r, staged=True)
    return forecast.boosted_forecast(view.sales(), view.calendar(), view.daily_prices(), 10, 28,
                                     boost.BoostParams(), HOLDOUT_ROWS)


# several rounds on one two-level factor: each group follows a recursion of its own
ROUNDS = 6
SOME_STEPS = boost.BoostParams(learning_rate=0.3, num_leaves=2, rounds=ROUNDS, row_sample=1.0, checkpoint_every=4)
_GROUPS = ("SELECT g, count(*) FILTER (WHERE d % 4 > 0) AS n, sum(y) FILTER (WHERE d % 4 > 0) AS s, "
           "count(*) FILTER (WHERE d % 4 = 0) AS hn, sum(y) FILTER (WHERE d % 4 = 0) AS hs, "
           "sum(y * y) FILTER (WHERE d % 4 = 0) AS hq FROM "
           "(SELECT s.d, s.sales AS y, e.weekday_flag AS g FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id) GROUP BY g")
_STEPS = f"""SELECT g, 0 AS trees, ln((SELECT sum(s) / sum(n) FROM grp)) AS f, n, s, hn, hs, hq FROM grp
  UNION ALL SELECT g, trees + 1, f + 0.3 * (s - n * exp(f)) / (n * exp(f) + 0.1), n, s, hn, hs, hq FROM steps WHERE trees < {ROUNDS}"""


def _stepped(s, r):
    rows, design = _flag_rows(s, r)
    held = F.col("d") % 4 == 0
    return rows, boost.fit_boosted_poisson(rows.where(~held), design, SOME_STEPS, validation=rows.where(held))


@query("m8_holdout_rmse", sql("""
SELECT trees, round(sqrt(sum(hq - 2 * exp(f) * hs + hn * exp(2 * f)) / sum(hn)), 7) AS rmse
FROM steps WHERE trees > 0 GROUP BY trees""", "dsales", "externals", recursive=True, grp=_GROUPS, steps=_STEPS))
def holdout_rmse(s, r):
    """The error on held rows after each round, as the fit stores it."""
    _, model = _stepped(s, r)
    rows = [(k, round(e, 7)) for k, e in enumerate(model.rmse, 1)]
    return s.createDataFrame(rows, "trees int, rmse double")


@query("m8_boost_rounds", sql("""
SELECT trees, g AS weekday_flag, round(exp(f), 7) AS mean FROM steps
WHERE trees > 0 AND trees <= (SELECT arg_min(trees, (e, trees)) FROM (
  SELECT trees, sum(hq - 2 * exp(f) * hs + hn * exp(2 * f)) AS e FROM steps WHERE trees > 0 GROUP BY trees))""",
    "dsales", "externals", recursive=True, grp=_GROUPS, steps=_STEPS))
def boost_rounds(s, r):
    """What the trees kept up to each round predict; those after the smallest error are gone."""
    rows, model = _stepped(s, r)
    cells, out = stage(rows.select("weekday_flag").distinct(), "cells"), []
    for k in range(1, len(model.trees) + 1):
        part = boost.BoostModel(model.base, model.design, model.params, model.trees[:k])
        out.append(boost.predict_boosted(cells, part).select(
            F.lit(k).alias("trees"), "weekday_flag", F.round("prediction", 7).alias("mean")))
    return reduce(DataFrame.unionByName, out)


_SPLIT_FACTORS = ["month", "wday", "day", "weekday_flag", "snap"]
_LEVEL_SUMS = " UNION ALL ".join(
    f"SELECT {i} AS feature, CAST({f} AS VARCHAR) AS level, count(*) AS n, sum(s.sales - mu) AS g, count(*) * any_value(mu) AS h "
    f"FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id CROSS JOIN (SELECT avg(sales) AS mu FROM dsales) GROUP BY {f}"
    for i, f in enumerate(_SPLIT_FACTORS))


@query("m10_first_split", sql("""
SELECT arg_min(feature, (-round(gain, 6), feature)) AS feature, round(max(gain), 3) AS gain
FROM (SELECT feature, pow(gl, 2) / (hl + 0.1) + pow(g - gl, 2) / (h - hl + 0.1) - pow(g, 2) / (h + 0.1) AS gain
      FROM (SELECT feature, sum(g) OVER part AS g, sum(h) OVER part AS h, sum(n) OVER part AS n,
                   sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(n) OVER upto AS nl FROM levels
            WINDOW part AS (PARTITION BY feature), upto AS (PARTITION BY feature ORDER BY g / (h + 0.1), level))
      WHERE nl >= 100 AND n - nl >= 100)""", "dsales", "externals", levels=_LEVEL_SUMS))
def first_split(s, r):
    """The parameter set at work: the first split over calendar factors and what it gains."""
    from tallycast.operators.joins import external_vars

    view = ob.daily_view(s, r, staged=True)
    rows = external_vars(view.sales(), view.calendar()).withColumnRenamed("sales", "y")
    design = default_design(view.calendar(), 0, calendar_factors=tuple(_SPLIT_FACTORS))
    params = replace(boost.BoostParams(), rounds=1, row_sample=1.0)
    model = boost.fit_boosted_poisson(rows, design, params)
    nodes = {n[0]: n for n in model.trees[0]}
    _, feature, _, levels, _, _, _ = nodes[0]
    # gain of the stored split, from sums over the rows on its two sides
    code = F.element_at(design.codes(), feature + 1)
    side = F.array_contains(F.lit([int(v) for v in levels]), code)
    mean = rows.agg(F.avg("y")).first()[0]
    sums = rows.groupBy(side.alias("left")).agg(F.sum(F.col("y") - mean).alias("g"), (F.count("*") * F.lit(mean)).alias("h"))
    part = F.pow("g", 2) / (F.col("h") + params.l2)
    whole = F.pow(F.sum("g"), 2) / (F.sum("h") + params.l2)
    return sums.agg((F.sum(part) - whole).alias("gain")).select(
        F.lit(feature).alias("feature"), F.round("gain", 3).alias("gain"))


@query("m9_cluster_boost_forecast")
def cluster_boost(s, r):
    view = ob.daily_view(s, r, staged=True)
    return forecast.cluster_forecast(view.sales(), view.calendar(), view.clusters(), LAGS, 28, "boost",
                                     boost.BoostParams(), HOLDOUT_ROWS)


# -- recursion ----------------------------------------------------------------------

_FIXED_LAGS, _FIXED_EXT = [0.5, 0.2], {"intercept": 0.1, "weekday_flag=1": 0.05}


@query("m11_linear_recursion", sql("""
SELECT id, h, round(yhat * mean, 6) AS yhat FROM rec WHERE h > 0""", "dsales", "externals", recursive=True,
    normal="SELECT id, state_id, d, sales / nullif(avg(sales) OVER (PARTITION BY id), 0) AS y, "
           "avg(sales) OVER (PARTITION BY id) AS mean FROM dsales",
    rec="""SELECT a.id, a.state_id, a.mean, a.d, 0 AS h, a.y AS yhat, b.y AS prev
  FROM normal a JOIN normal b ON b.id = a.id AND b.d = a.d - 1 WHERE a.d = (SELECT max(d) FROM dsales)
  UNION ALL
  SELECT p.id, p.state_id, p.mean, p.d + 1, p.h + 1,
         0.5 * p.yhat + 0.2 * p.prev + 0.1 + 0.05 * e.weekday_flag, p.yhat
  FROM rec p JOIN externals e ON e.d = p.d + 1 AND e.state_id = p.state_id WHERE p.h < 28"""))
def linear_recursion(s, r):
    parts = lags.future_parts(ob.daily_sales(s, r), ob.daily_calendar(s, r), 2, 28)
    design = Design(2, {"weekday_flag": ["0", "1"]}, intercept=True, drop_first=True)
    fc = recursion.forecast_fixed(*parts, _FIXED_LAGS, _FIXED_EXT, design, scaled=True)
    return fc.withColumn("yhat", F.round("yhat", 6))


@query("m11_log_recursion", sql("""
SELECT id, h, round(yhat, 6) AS yhat FROM rec WHERE h > 0""", "dsales", recursive=True,
    rec="""SELECT id, d, 0 AS h, CAST(sales AS DOUBLE) AS yhat FROM dsales WHERE d = (SELECT max(d) FROM dsales)
  UNION ALL SELECT id, d + 1, h + 1, exp(1.5 + 0.01 * yhat) FROM rec WHERE h < 28"""))
def log_recursion(s, r):
    parts = lags.future_parts(ob.daily_sales(s, r), ob.daily_calendar(s, r), 1, 28, normalized=False)
    design = Design(1, {}, intercept=True)
    fc = recursion.forecast_fixed(*parts, [0.01], {"intercept": 1.5}, design, link="log")
    return fc.withColumn("yhat", F.round("yhat", 6))


# two trees over two lags and a flag, walked 28 steps: (node, feature, threshold, left levels, left, right, value)
_FIXED_TREES = [
    [(0, 0, 60.0, None, 1, 2, 0.0), (1, 2, float("-inf"), [1.0], 3, 4, 0.0), (2, -1, 0.0, None, -1, -1, 0.25),
     (3, -1, 0.0, None, -1, -1, -0.5), (4, -1, 0.0, None, -1, -1, 0.125)],
    [(0, 1, 20.0, None, 1, 2, 0.0), (1, -1, 0.0, None, -1, -1, -0.25), (2, 0, 95.0, None, 3, 4, 0.0),
     (3, -1, 0.0, None, -1, -1, 0.0625), (4, -1, 0.0, None, -1, -1, -0.75)],
]


def tree_case(nodes: list[tuple], columns: list[str], at: int = 0) -> str:
    """The value of a tree as nested SQL cases over the columns of its features."""
    _, feature, threshold, levels, left, right, value = nodes[at]
    if feature < 0:
        return repr(float(value))
    test = f"{columns[feature]} IN ({', '.join(str(int(v)) for v in levels)})" if levels \
        else f"{columns[feature]} <= {float(threshold)!r}"
    return f"CASE WHEN {test} THEN {tree_case(nodes, columns, left)} ELSE {tree_case(nodes, columns, right)} END"


# the flag's codes: 1 is its first level (0), 2 its second (1)
_WALK = " + ".join(tree_case(t, ["p.yhat", "p.prev", "(e.weekday_flag + 1)"]) for t in _FIXED_TREES)


@query("m11_tree_recursion", sql("SELECT id, h, round(yhat, 6) AS yhat FROM rec WHERE h > 0",
                                 "dsales", "externals", recursive=True, rec=f"""
  SELECT a.id, a.state_id, a.d, 0 AS h, CAST(a.sales AS DOUBLE) AS yhat, CAST(b.sales AS DOUBLE) AS prev
  FROM dsales a JOIN dsales b ON b.id = a.id AND b.d = a.d - 1 WHERE a.d = (SELECT max(d) FROM dsales)
  UNION ALL
  SELECT p.id, p.state_id, p.d + 1, p.h + 1, exp(4.0 + {_WALK}), p.yhat
  FROM rec p JOIN externals e ON e.d = p.d + 1 AND e.state_id = p.state_id WHERE p.h < 28"""))
def tree_recursion(s, r):
    """Stored trees, read back and walked by the forecaster; SQL walks the same nodes."""
    view = ob.daily_view(s, r, staged=True)
    path = scratch_path(s, "trees")
    design = Design(2, {"weekday_flag": ["0", "1"]})
    boost.save_boosted(boost.BoostModel(4.0, design, boost.BoostParams(), _FIXED_TREES), s, path)
    parts = lags.future_parts(view.sales(), view.calendar(), 2, 28, normalized=False)
    fc = boost.forecast_boosted(*parts, boost.load_boosted(s, path))
    return fc.withColumn("yhat", F.round("yhat", 6))


# -- errors on held rows ------------------------------------------------------------

_HELD = """SELECT *, row_number() OVER (PARTITION BY cat_id ORDER BY md5('777|' || id || '|' || d))
    <= least(300, floor(count(*) OVER (PARTITION BY cat_id) / 5)) AS held FROM raw"""


@query("f16_holdout_rmse", sql("""
SELECT model, count(*) AS n, 0 AS missing, round(sqrt(avg(pow(y - prediction, 2))), 5) AS rmse FROM (
  SELECT 'linear' AS model, y, (SELECT regr_intercept(y, lag1) FROM marked WHERE NOT held)
    + (SELECT regr_slope(y, lag1) FROM marked WHERE NOT held) * lag1 AS prediction FROM marked WHERE held
  UNION ALL
  SELECT 'poisson', y, mu FROM marked JOIN (SELECT cat_id, avg(y) AS mu FROM marked WHERE NOT held GROUP BY cat_id) USING (cat_id) WHERE held
  UNION ALL
  SELECT 'boosted', y, mean FROM marked JOIN (
    SELECT g, exp(ln(any_value(mu)) + 0.5 * sum(y - mu) / (sum(mu) + 0.1)) AS mean
    FROM marked CROSS JOIN (SELECT avg(y) AS mu FROM marked WHERE NOT held) WHERE NOT held GROUP BY g) USING (g) WHERE held)
GROUP BY model""", "dsales", "externals", raw="""
  SELECT * FROM (SELECT s.id, s.cat_id, s.d, CAST(s.sales AS DOUBLE) AS y, e.weekday_flag AS g,
                        lag(s.sales) OVER (PARTITION BY s.id ORDER BY s.d) AS lag1
                 FROM dsales s JOIN externals e ON e.d = s.d AND e.state_id = s.state_id) WHERE lag1 IS NOT NULL""", marked=_HELD))
def fitted_on_held_rows(s, r):
    """A linear, a Poisson and a boosted model fitted on the same rows, measured on the same others."""
    view = ob.daily_view(s, r, staged=True)
    rows = lags.training_matrix(view.sales(), view.calendar(), 1, normalized=False)
    marked = stage(sampling.holdout_by(rows, "cat_id", 300, 777, ["id", "d"], share=5), "marked")
    train, held = marked.where("not held").drop("held"), marked.where("held").drop("held")

    line = Design(1, intercept=True, drop_first=True)
    lag_beta, ext = ols.mllib_coefficients(ols.fit_linear_regression(train, line), line)
    linear = F.element_at("lags", 1) * lag_beta[0] + ext["intercept"]
    groups = Design(0, {"cat_id": sorted(x[0] for x in train.select("cat_id").distinct().collect())},
                    intercept=True, drop_first=True)
    _, effects = ols.mllib_coefficients(poisson.fit_poisson(train, groups), groups)
    trees = boost.fit_boosted_poisson(train, Design(0, {"weekday_flag": ["0", "1"]}), ONE_STEP)
    predictions = [
        held.select(F.lit("linear").alias("model"), "id", "d", linear.alias("prediction")),
        held.select(F.lit("poisson").alias("model"), "id", "d",
                    F.exp(groups.external_effect(recursion._map_literal(effects))).alias("prediction")),
        boost.predict_boosted(held, trees).select(F.lit("boosted").alias("model"), "id", "d", "prediction"),
    ]
    stored = stage(reduce(DataFrame.unionByName, predictions), "predictions")
    return evaluate.holdout_rmse(held, stored).withColumn("rmse", F.round("rmse", 5))


# -- intermittent demand ------------------------------------------------------------

_STEP = """CASE WHEN s.sales > 0 AND p.size IS NOT NULL THEN p.size + {a} * (s.sales - p.size)
              WHEN s.sales > 0 THEN s.sales ELSE p.size END AS size,
         CASE WHEN s.sales > 0 AND p.size IS NOT NULL THEN p.gap + {a} * (p.since - p.gap)
              WHEN s.sales > 0 THEN p.since ELSE p.gap END AS gap,
         CASE WHEN s.sales > 0 THEN 1.0 ELSE p.since + 1 END AS since"""
_CROSTON = f"""SELECT id, 0 AS d, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS gap, CAST(1 AS DOUBLE) AS since
  FROM (SELECT DISTINCT id FROM cells)
  UNION ALL SELECT p.id, p.d + 1, {_STEP.format(a="CAST(0.1 AS DOUBLE)")}
  FROM st p JOIN sales s ON s.id = p.id AND s.d = p.d + 1"""

for _n, (_variant, _factor) in enumerate({
    "croston": "1.0", "sba": "(1 - CAST(0.1 AS DOUBLE) / 2)",
    "sbj": "(1 - CAST(0.1 AS DOUBLE) / (2 - CAST(0.1 AS DOUBLE)))",
}.items()):
    query(f"m{12 + _n}_{_variant}", sql(f"""
SELECT id, CAST(h.h AS INT) AS h, coalesce({_factor} * size / gap, 0) AS yhat
FROM st CROSS JOIN range(1, 57) h(h) WHERE d = {LAST}""", "sales", recursive=True, st=_CROSTON))(
        lambda s, r, v=_variant: intermittent.croston(ob.monthly_sales(s, r), 56, 0.1, v))

_GRID = f"""SELECT id, a, 0 AS d, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS gap,
         CAST(1 AS DOUBLE) AS since, CAST(0 AS DOUBLE) AS loss
  FROM (SELECT DISTINCT id FROM cells) CROSS JOIN (SELECT CAST(unnest([{', '.join(str(a) for a in intermittent.ALPHA_GRID)}]) AS DOUBLE) AS a)
  UNION ALL SELECT p.id, p.a, p.d + 1, {_STEP.format(a="p.a")},
         CASE WHEN p.size IS NOT NULL THEN p.loss + pow(s.sales - 1.0 * p.size / p.gap, 2) ELSE p.loss END
  FROM st p JOIN sales s ON s.id = p.id AND s.d = p.d + 1"""


@query("m15_croston_grid", sql("""
SELECT id, arg_min(a, (loss, a)) AS alpha, round(coalesce(arg_min(size / gap, (loss, a)), 0), 8) AS level
FROM (SELECT id, a, size, gap, round(loss, 6) AS loss FROM st WHERE d = (SELECT max(d) FROM sales)) GROUP BY id""", "sales", recursive=True, st=_GRID))
def croston_grid(s, r):
    level = intermittent.smoothing_level(ob.monthly_sales(s, r), "grid", "croston", cost="mse")
    return level.select("id", F.col("alpha_gap").alias("alpha"), F.round("level", 8).alias("level"))


# the default cost compares the running mean rate with the corrected forecast
_SBJ = "(1 - p.a / (2 - p.a)) * p.size / p.gap"
_GRID_MAR = f"""SELECT id, a, 0 AS d, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS gap,
         CAST(1 AS DOUBLE) AS since, CAST(0 AS DOUBLE) AS loss, CAST(0 AS DOUBLE) AS total
  FROM (SELECT DISTINCT id FROM {{source}}) CROSS JOIN (SELECT CAST(unnest([{', '.join(str(a) for a in intermittent.ALPHA_GRID)}]) AS DOUBLE) AS a)
  UNION ALL SELECT p.id, p.a, p.d + 1, {_STEP.format(a="p.a")},
         CASE WHEN p.size IS NOT NULL THEN p.loss + abs((p.total + s.sales) / (p.d + 1) - {_SBJ}) ELSE p.loss END,
         p.total + s.sales
  FROM st p JOIN {{source}} s ON s.id = p.id AND s.d = p.d + 1"""
_BEST_SBJ = """SELECT id, arg_min(a, (loss, a)) AS alpha,
  coalesce(arg_min((1 - a / (2 - a)) * size / gap, (loss, a)), 0) AS level
  FROM (SELECT id, a, size, gap, round(loss, 9) AS loss FROM st WHERE d = (SELECT max(d) FROM sales)) GROUP BY id"""


@query("m15_grid_mar_sbj", sql("SELECT id, round(level, 6) AS level FROM best", "sales", recursive=True,
                               st=_GRID_MAR.format(source="sales"), best=_BEST_SBJ))
def grid_mar_sbj(s, r):
    level = intermittent.smoothing_level(ob.monthly_sales(s, r), "grid", "sbj")
    return level.select("id", F.round("level", 6).alias("level"))


_CLASSED = ("SELECT id, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'croston' ELSE 'sba' END AS demand_class FROM dem")
# months summed over the stores of an item make both classes occur
_BY_ITEM_STATE = ("SELECT state_id || '_' || item_id AS id, d, sum(sales) AS sales FROM sales GROUP BY ALL")


def _item_state(s, r):
    """Staged: the jobs on it have several branches."""
    sales = ob.monthly_sales(s, r)
    name = F.concat_ws("_", "state_id", "item_id")
    return stage(sales.groupBy(name.alias("id"), "d").agg(F.sum("sales").alias("sales")), "item-state")


_DEM2 = _DEMAND.replace("FROM sales", "FROM grouped")

query("m16_classify_sbc", sql("SELECT id, demand_class FROM cls", "sales", grouped=_BY_ITEM_STATE, dem=_DEM2, cls=_CLASSED))(
    lambda s, r: intermittent.classify_sbc(_item_state(s, r)).select("id", "demand_class"))


@query("m17_route", sql(
    "SELECT demand_class, g.id, d, sales FROM grouped g JOIN cls USING (id)",
    "sales", grouped=_BY_ITEM_STATE, dem=_DEM2, cls=_CLASSED))
def route(s, r):
    sales = _item_state(s, r)
    parts = intermittent.route(sales, intermittent.classify_sbc(sales))
    tagged = [df.withColumn("demand_class", F.lit(c)) for c, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).select("demand_class", "id", "d", "sales")


@query("h8_route_union", sql(f"""
SELECT id, CAST(h.h AS INT) AS h, CASE demand_class WHEN 'croston' THEN last ELSE mean END AS yhat
FROM cls JOIN (SELECT id, round(avg(sales), 6) AS mean, max(CASE WHEN d = (SELECT max(d) FROM sales) THEN sales END) AS last FROM grouped GROUP BY id)
  USING (id) CROSS JOIN range(1, {H + 1}) h(h)""", "sales", grouped=_BY_ITEM_STATE, dem=_DEM2, cls=_CLASSED))
def route_union(s, r):
    sales = _item_state(s, r)
    last = ob.n_months(s, r)
    smooth = forecast.mean_forecast(sales, last, H).withColumn("yhat", F.round("yhat", 6))
    classes = stage(intermittent.classify_sbc(sales), "classes")
    return intermittent.route_union(forecast.naive(sales, last, H), smooth, classes)


@query("m17_combined_forecast", sql("""
SELECT id, CAST(h.h AS INT) AS h, round(CASE demand_class WHEN 'croston' THEN last ELSE greatest(level, 0) END, 6) AS yhat
FROM cls JOIN best USING (id)
  JOIN (SELECT id, max(sales) FILTER (WHERE d = (SELECT max(d) FROM sales)) AS last FROM grouped GROUP BY id) USING (id)
  CROSS JOIN range(1, 57) h(h)""", "sales", recursive=True, grouped=_BY_ITEM_STATE, dem=_DEM2, cls=_CLASSED,
    st=_GRID_MAR.format(source="grouped"), best=_BEST_SBJ))
def combined(s, r):
    sales = _item_state(s, r).withColumns({k: F.col("id") for k in ("item_id", "dept_id", "cat_id", "store_id", "state_id")})
    fc = forecast.combined_forecast(sales, forecast.naive(sales, ob.n_months(s, r), 56), 56)
    return fc.withColumn("yhat", F.round("yhat", 6))


# -- output -------------------------------------------------------------------------


def _columns(expr: str, n: int = 28) -> str:
    return ", ".join(expr.format(h=h) + f" AS F{h}" for h in range(1, n + 1))


@query("m19_assemble_output", sql(f"""
SELECT item_id || '_' || store_id || '_validation' AS id, {_columns("max(CASE WHEN d = m - 28 + {h} THEN sales END)")}
FROM tail GROUP BY item_id, store_id UNION ALL
SELECT item_id || '_' || store_id || '_evaluation', {_columns(
    "(max(CASE WHEN d = m THEN sales END) + max(CASE WHEN d = m - 36 + {h} THEN sales END)) / 2")}
FROM tail GROUP BY item_id, store_id""", "sales", tail="SELECT sales.*, m FROM sales, (SELECT max(d) AS m FROM sales)"))
def assemble_output(s, r):
    view = ob.monthly_view(s, r, staged=True)
    sales, last = view.sales(), view.last
    fc = series.ensemble_mean([forecast.naive(sales, last, 28), forecast.seasonal_naive(sales, last, 28, 36)])
    return assemble.output_wide(assemble.assemble_output(sales, fc))


@query("m20_assemble_output_56", sql(f"""
SELECT item_id || '_' || store_id || st AS id, {_columns("max(CASE WHEN d = (SELECT max(d) FROM sales) THEN sales END) + 0 * {h}")}
FROM sales CROSS JOIN (VALUES ('_validation'), ('_evaluation')) v(st) GROUP BY item_id, store_id, st""", "sales"))
def assemble_output_56(s, r):
    view = ob.monthly_view(s, r, staged=True)
    names = view.cells.select("id", "item_id", "store_id").distinct()
    return assemble.output_wide(assemble.assemble_output_56(forecast.naive(view.sales(), view.last, 56), names))


# per output name: the mean line quantity of each month of the newest year, missing where none was sold
_NAMED = f"""
  SELECT CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'HOBBIES'
              WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'HOUSEHOLD' ELSE 'FOOD' END
         || '_' || (p_size % 3 + 1) || '_' || regexp_extract(p_brand, '([0-9]+)', 1) AS item_id,
         CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' ELSE 'WI' END || '_' || (n_nationkey % 4 + 1) AS store_id,
         month(CAST(l_shipdate AS DATE)) AS h, round(avg(l_quantity), 6) AS yhat
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL"""


@query("m21_assemble_output_copy", sql(f"""
SELECT item_id || '_' || store_id || st AS id,
  {", ".join(f"coalesce(max(CASE WHEN h = {h} THEN yhat END), 0) AS F{h}" for h in range(1, 29))}
FROM named CROSS JOIN (VALUES ('_validation'), ('_evaluation')) v(st) GROUP BY item_id, store_id, st""", named=_NAMED))
def assemble_output_copy(s, r):
    """A forecast by month of the year: steps past December, and months never sold in, are missing."""
    lines = output_lines(s, r)
    long = lines.groupBy("item_id", "store_id", F.month("l_shipdate").alias("h")).agg(
        F.round(F.avg("l_quantity"), 6).alias("yhat"))
    named = long.select(F.concat_ws("_", "item_id", "store_id", F.lit("validation")).alias("id"), "h", "yhat")
    return assemble.assemble_output_copy(named)


@query("m22_holdouts", sql(f"""
SELECT 'test' AS part, id, d, sales FROM sales WHERE d BETWEEN {CUTOFF - 5} AND {CUTOFF} UNION ALL
SELECT 'train', id, d, sales FROM sales WHERE d <= {CUTOFF} - 6""", "sales"))
def holdouts(s, r):
    parts = score.make_holdouts(ob.monthly_sales(s, r), ob.monthly_calendar(s, r), CUTOFF, 6)
    tagged = [df.select(F.lit(n).alias("part"), "id", "d", "sales") for n, df in parts.items()]
    return tagged[0].unionByName(tagged[1])


@query("m22_holdout_window", sql("""
SELECT id, CAST(d - (DATE '2000-05-23' - (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + 1) + 1942 AS INT) AS d, sales FROM dsales
WHERE (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + (d - 1) BETWEEN DATE '2000-05-23' AND DATE '2000-06-19'""", "dsales"))
def holdout_window(s, r):
    parts = score.make_holdouts(ob.daily_sales(s, r), ob.daily_calendar(s, r), 0,
                                window=("2000-05-23", "2000-06-19"), relabel_from=1942)
    return parts["test"].select("id", "d", "sales")


@query("m23_train_hierarchy", sql(
    levels_sql("masked", lenient_sum("value") + " AS value", bottom=strict_sum("value") + " AS value"),
    "sales", masked=_MASKED))
def train_hierarchy(s, r):
    view = ob.monthly_view(s, r, staged=True)
    return score.train_hierarchy(view.sales(), view.calendar(), view.prices())
