"""Models against brute force on small panels, and the properties of their fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.models import boost, ols, poisson
from tallycast.models.design import Design
from tallycast.models.recursion import forecast_zip, split_frame

SCHEMA = "id string, d int, g string, season string, same string, y double, lags array<double>, mean double"


@pytest.fixture(scope="module")
def rows(spark):
    """Counts with many zeros; group ``hot`` holds most rows; ``same`` copies ``season``."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(1200):
        g = "hot" if i % 5 else "cold"
        season = str(i % 3)
        lags = rng.poisson(2.0, 2).astype(float)
        rate = np.exp(0.3 + 0.1 * lags[0] + 0.2 * (season == "1") + 0.3 * (g == "hot"))
        y = 0.0 if rng.random() < 0.3 else float(rng.poisson(rate))
        out.append((f"s{i}", i, g, season, f"x{season}", y, lags.tolist(), 1.0))
    return spark.createDataFrame(out, SCHEMA).repartition(6).cache()


FACTORS = {"season": ["0", "1", "2"], "same": ["x0", "x1", "x2"]}


def dense(pdf, factors):
    parts = [np.vstack(pdf["lags"])]
    parts += [(pdf[f].to_numpy()[:, None] == np.array(v)[None, :]).astype(float) for f, v in factors.items()]
    return np.hstack(parts)


def test_cluster_ols_is_least_squares(rows):
    """Rank-deficient design, one dominant group: fitted values equal direct lstsq."""
    design = Design(2, FACTORS)
    fits = {r["g"]: r for r in ols.fit_ols(rows, design, "g").collect()}
    for g, pdf in rows.toPandas().groupby("g"):
        x = dense(pdf, FACTORS)
        want = x @ np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
        beta = list(fits[g]["lag_beta"]) + [fits[g]["ext_beta"][n] for n in design.names[2:]]
        assert np.abs(x @ np.array(beta) - want).max() < 1e-8


def test_drop_aliased_and_linear_regression(rows):
    full = Design(2, FACTORS, intercept=True, drop_first=True)
    design = ols.drop_aliased(rows, full)
    assert design.aliased == ("same=x1", "same=x2")
    model = ols.fit_linear_regression(rows, design)
    lag_beta, rest = ols.mllib_coefficients(model, design)
    grams = ols.fit_ols(rows, design).first()
    assert lag_beta == pytest.approx(list(grams["lag_beta"]), abs=1e-6)
    assert rest == pytest.approx(dict(grams["ext_beta"]), abs=1e-6)


def test_poisson_score_equations(rows):
    design = Design(2, {"season": FACTORS["season"]}, intercept=True, drop_first=True)
    model = poisson.fit_poisson(rows, design)
    pdf = rows.toPandas()
    x = np.column_stack([np.ones(len(pdf)), dense(pdf, {"season": FACTORS["season"]})])
    x = np.delete(x, 3, axis=1)  # the reference level
    beta = np.concatenate([[model.intercept], model.coefficients.toArray()])
    score = x.T @ (pdf["y"].to_numpy() - np.exp(x @ beta))
    assert np.abs(score).max() < 1e-3


def test_zip_likelihood_rises_and_means_match(rows):
    design = Design(2, {"season": FACTORS["season"]}, intercept=True, drop_first=True)
    zero = Design(2, {}, intercept=True)
    model = poisson.fit_zip(rows, design, zero, max_iter=40)
    ll = model.log_likelihood
    assert len(ll) > 2 and all(b >= a - 1e-9 for a, b in zip(ll, ll[1:]))
    frame = rows.select("id", "lags", "mean", "season", F.lit(1).alias("h"))
    fitted = forecast_zip(*split_frame(frame), model).agg(F.avg("yhat")).first()[0]
    assert fitted == pytest.approx(rows.agg(F.avg("y")).first()[0], rel=0.02)


def test_boosting(spark, rows, tmp_path):
    params = boost.BoostParams(rounds=4, num_leaves=8, min_rows_per_leaf=20, checkpoint_every=1,
                               learning_rate=0.3)
    design = Design(2, {"season": FACTORS["season"], "g": ["cold", "hot"]})
    model = boost.fit_boosted_poisson(rows, design, params)
    assert all(b < a for a, b in zip(model.deviance, model.deviance[1:]))
    # the numpy scorer gives the loss that the fit tracked through MLlib's leaves
    scored = boost.predict_boosted(rows, model).agg(
        F.avg(F.col("prediction") - F.col("y") * F.log("prediction"))).first()[0]
    assert scored == pytest.approx(model.deviance[-1], abs=1e-9)

    boost.save_boosted(model, spark, str(tmp_path / "m"))
    loaded = boost.load_boosted(spark, str(tmp_path / "m"))
    assert loaded.params == params and loaded.design == design
    x = np.array([[1.0, 2.0, 2, 1], [0.0, 0.0, 1, 2]])
    assert (loaded.scorer().log_mean(x) == model.scorer().log_mean(x)).all()

    frame = rows.where("d < 10").select("id", "lags", "mean", "season", "g",
                                        F.explode(F.array(F.lit(1), F.lit(2))).alias("h"))
    got = {(r["id"], r["h"]): r["yhat"] for r in boost.forecast_boosted(*split_frame(frame), model).collect()}
    scorer = model.scorer()
    for r in rows.where("d < 10").collect():
        codes = [int(r["season"]) + 1, 2 if r["g"] == "hot" else 1]
        first = np.exp(scorer.log_mean(np.array([[*r["lags"], *codes]])))[0]
        second = np.exp(scorer.log_mean(np.array([[first, r["lags"][0], *codes]])))[0]
        assert (got[r["id"], 1], got[r["id"], 2]) == pytest.approx((first, second))


def test_default_boost_settings():
    p = boost.BoostParams()
    assert (p.learning_rate, p.num_leaves, p.min_rows_per_leaf, p.l2, p.row_sample, p.rounds, p.depth) \
        == (0.075, 128, 100, 0.1, 0.75, 1200, 7)


def test_boosting_ends_on_the_validation_error(rows):
    params = boost.BoostParams(rounds=40, num_leaves=8, min_rows_per_leaf=20, checkpoint_every=4,
                               learning_rate=0.8, patience=3)
    design = Design(2, {"season": FACTORS["season"], "g": ["cold", "hot"]})
    held, train = rows.where("d % 4 = 0"), rows.where("d % 4 > 0")
    model = boost.fit_boosted_poisson(train, design, params, validation=held)
    best = min(range(len(model.rmse)), key=model.rmse.__getitem__)
    assert len(model.rmse) < 40 and len(model.trees) == best + 1
    got = boost.predict_boosted(held, model).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))).first()[0]
    assert got == pytest.approx(model.rmse[best], abs=1e-9)


def test_cluster_fits_end_on_their_own_validation_error(rows):
    params = boost.BoostParams(rounds=30, num_leaves=8, min_rows_per_leaf=20, checkpoint_every=4,
                               learning_rate=0.8, patience=2)
    design = Design(2, {"season": FACTORS["season"]})
    models = boost.fit_boosted_by_cluster(rows, design, "g", params, holdout_rows=100)
    assert set(models) == {"hot", "cold"}
    for model in models.values():
        best = min(range(len(model.rmse)), key=model.rmse.__getitem__)
        assert 0 < len(model.rmse) < 30 and len(model.trees) == best + 1


SOME = boost.BoostParams(rounds=7, num_leaves=8, min_rows_per_leaf=20, checkpoint_every=2, learning_rate=0.3)
LAYOUT = Design(2, {"season": FACTORS["season"]})


def test_blocks_of_any_size_grow_the_same_trees(monkeypatch, rows):
    """One block per cluster (grown in its task) and many (level by level, through an exchange)."""
    whole = boost.fit_boosted_by_cluster(rows, LAYOUT, "g", SOME, holdout_rows=100)
    monkeypatch.setattr(boost, "BLOCK_CELLS", 3 * 300)
    monkeypatch.setattr(boost, "RANGE", 2)
    cut = boost.fit_boosted_by_cluster(rows, LAYOUT, "g", SOME, holdout_rows=100)
    assert set(whole) == set(cut) == {"hot", "cold"}
    for g, model in whole.items():
        assert cut[g].rmse == pytest.approx(model.rmse) and len(cut[g].trees) == len(model.trees)
        for a, b in zip(model.trees, cut[g].trees):
            assert sorted(n[1:4] for n in a if n[1] >= 0) == sorted(n[1:4] for n in b if n[1] >= 0)
            assert sorted(n[6] for n in a) == pytest.approx(sorted(n[6] for n in b))


def test_interrupted_fit_goes_on(monkeypatch, rows, tmp_path):
    """Stopped in its third step, the fit resumes after the second and ends with the same trees."""
    want = boost.fit_boosted_by_cluster(rows, LAYOUT, "g", SOME, holdout_rows=100)
    plain, steps = boost._rewritten, []

    def counted(*args):
        steps.append(1)
        if len(steps) == 3:
            raise InterruptedError
        return plain(*args)

    monkeypatch.setattr(boost, "_rewritten", counted)
    state = str(tmp_path / "fit")
    with pytest.raises(InterruptedError):
        boost.fit_boosted_by_cluster(rows, LAYOUT, "g", SOME, holdout_rows=100, state=state)
    got = boost.fit_boosted_by_cluster(rows, LAYOUT, "g", SOME, holdout_rows=100, state=state)
    assert len(steps) == 3 + 2  # four steps of up to two rounds in all, two of them before
    for g, model in want.items():
        assert got[g].trees == model.trees and got[g].rmse == model.rmse


def test_sums_of_every_leaf(rows):
    """Each leaf of a first tree on all rows holds rate * sum(y - mu) / (sum(mu) + l2)."""
    from dataclasses import replace

    params = replace(SOME, rounds=1, row_sample=1.0)
    model = boost.fit_boosted_poisson(rows, LAYOUT, params)
    one = boost.predict_boosted(rows, model).toPandas()
    mean = one["y"].mean()
    for value, part in one.groupby(one["prediction"].round(9)):
        n, total = len(part), part["y"].sum()
        assert np.log(value) == pytest.approx(np.log(mean) + 0.3 * (total - n * mean) / (n * mean + 0.1), abs=1e-8)
        assert n >= 20
    assert one["prediction"].round(9).nunique() > 4


def test_forecast_equals_sql_over_stored_trees(spark, sf_dir, tmp_path):
    """Cluster models on ten lags: DuckDB walks the stored nodes over 28 steps."""
    import duckdb

    from tallycast.models.design import default_design
    from tallycast.operators import lags
    from tallycast.sources import orderbook as ob

    view = ob.daily_view(spark, sf_dir, staged=True)
    sales, calendar, clusters = view.sales(), view.calendar(), view.clusters()
    design = default_design(calendar, 10, calendar_factors=("weekday_flag", "month"))
    train = lags.training_matrix(sales, calendar, 10, clusters)
    models = boost.fit_boosted_by_cluster(train, design, "cluster_id", boost.BoostParams(rounds=5, num_leaves=16))
    origin, days = lags.future_parts(sales, calendar, 10, 28, clusters)
    got = {(r["id"], r["h"]): r["yhat"] for r in boost.forecast_boosted(
        origin, days, models, scaled=True, by="cluster_id").collect()}

    con = duckdb.connect()
    nodes = [(int(c), m.base, t, *n) for c, m in models.items() for t, tree in enumerate(m.trees) for n in tree]
    con.execute("CREATE TABLE nodes (c INT, base DOUBLE, tree INT, node INT, feature INT, threshold DOUBLE, "
                "levels DOUBLE[], l INT, r INT, value DOUBLE)")
    con.executemany("INSERT INTO nodes VALUES (?,?,?,?,?,?,?,?,?,?)", nodes)
    codes = {(r["id"], r["h"]): list(r["x"]) for r in days.select("id", "h", design.codes().alias("x")).collect()}
    con.execute("CREATE TABLE state (id VARCHAR, c INT, mean DOUBLE, lags DOUBLE[])")
    con.executemany("INSERT INTO state VALUES (?,?,?,?)", [
        (r["id"], r["cluster_id"], r["mean"], list(r["lags"])) for r in origin.collect()])
    con.execute("CREATE TABLE codes (id VARCHAR, h INT, x DOUBLE[])")
    con.executemany("INSERT INTO codes VALUES (?,?,?)", [(i, h, x) for (i, h), x in codes.items()])
    for h in range(1, 29):
        step = con.execute(f"""
            WITH RECURSIVE x AS (SELECT s.id, s.c, s.mean, s.lags, list_concat(s.lags, k.x) AS v
                                 FROM state s JOIN codes k ON k.id = s.id AND k.h = {h}),
            walk AS (
              SELECT x.id, n.tree, n.node, n.feature, n.threshold, n.levels, n.l, n.r, n.value, n.base, x.v
              FROM x JOIN nodes n ON n.c = x.c AND n.node = 0
              UNION ALL
              SELECT w.id, w.tree, n.node, n.feature, n.threshold, n.levels, n.l, n.r, n.value, n.base, w.v
              FROM walk w JOIN x ON x.id = w.id JOIN nodes n ON n.c = x.c AND n.tree = w.tree AND n.node =
                CASE WHEN CASE WHEN w.levels IS NULL THEN w.v[w.feature + 1] <= w.threshold
                               ELSE list_contains(w.levels, w.v[w.feature + 1]) END THEN w.l ELSE w.r END
              WHERE w.feature >= 0)
            SELECT x.id, x.mean, x.lags, exp(any_value(w.base) + sum(w.value)) AS y
            FROM walk w JOIN x USING (id) WHERE w.feature < 0 GROUP BY x.id, x.mean, x.lags""").fetchall()
        assert len(step) == len({i for i, _ in got})
        for i, mean, _, y in step:
            assert got[i, h] == pytest.approx(y * mean, rel=1e-9)
        con.execute("CREATE OR REPLACE TABLE moved (id VARCHAR, lags DOUBLE[])")
        con.executemany("INSERT INTO moved VALUES (?,?)", [(i, [y, *old[:-1]]) for i, _, old, y in step])
        con.execute("UPDATE state SET lags = moved.lags FROM moved WHERE moved.id = state.id")


def test_registered_cluster_boosting_ends(spark, sf_dir):
    """The registered query itself, with the task's parameters and its 400 lags."""
    from catalog import models

    fc = models.cluster_boost(spark, sf_dir).collect()
    ids = {r["id"] for r in fc}
    assert len(fc) == 28 * len(ids) and all(r["yhat"] is not None and r["yhat"] >= 0 for r in fc)


def test_zip_reaches_the_maximum(rows):
    """Scores of both parts vanish, lags and factors included."""
    design = Design(2, {"season": FACTORS["season"]}, intercept=True, drop_first=True)
    zero = Design(2, {"season": FACTORS["season"]}, intercept=True, drop_first=True)
    model = poisson.fit_zip(rows, design, zero, tol=1e-14)
    assert len(model.log_likelihood) < 20
    packed = poisson._packed_pair(rows, design, zero)
    _, count, _, hidden, _, _ = poisson._em_sums(packed, design, zero, model.count_beta, model.zero_beta)
    assert np.abs(count).max() < 1e-4 and np.abs(hidden).max() < 1e-4


def test_a_factor_of_many_levels(spark):
    """100,000 levels, three rows each and a numeric column: the level means come back."""
    from tallycast.models import levels

    n = 100_000
    item = F.col("id") % n
    df = spark.range(3 * n).select(item.cast("string").alias("item"), (item % 7).cast("string").alias("kind"),
                                   ((item % 13) + F.when(F.col("id") < n, 1.0).otherwise(-0.5)).alias("y"))
    table = levels.level_table(df, ["item", "kind"])
    assert levels.level_counts(table) == {"item": n, "kind": 7}
    coded, first = levels.sparse_features(df.limit(10), table, ["item", "kind"])
    vector = coded.first()["features"]
    assert first == {"item": 0, "kind": n} and vector.size == n + 7 and vector.numNonzeros() == 2
    fitted = levels.fit_sparse_linear(df, table.where("factor = 'item'"), ["item"])
    off = fitted.where(F.abs(F.col("beta") - F.col("level").cast("int") % 13) > 1e-3).count()
    assert fitted.count() == n and off == 0
    unknown = spark.createDataFrame([(None, "8", 1.0)], "item string, kind string, y double")
    assert levels.sparse_features(unknown, table, ["item", "kind"])[0].first()["features"].numNonzeros() == 0
