"""Hand-made frames: null rules, scale, weights, smoothing, windows, recursion."""

import pytest
from pyspark.sql import functions as F

from tallycast.functions.nulls import lenient_sum, strict_avg, strict_sum
from tallycast.models.design import Design
from tallycast.models.recursion import forecast_fixed, split_frame
from tallycast.operators import hierarchy, intermittent, lags, sampling, scoring, series
from tallycast.operators.encode import encode_sorted
from tallycast.operators.ordering import with_position
from tallycast.operators.reshape import to_long, to_wide
from tallycast.schema import KEYS, LEVELS
from tallycast.sources import readers, writers

SALES = ", ".join(f"{k} string" for k in KEYS) + ", d int, sales double"


def sales_rows(values, item="i", dept="p", cat="c", store="s", state="a"):
    return [(f"{item}_{store}", item, dept, cat, store, state, d, v)
            for d, v in enumerate(values, start=1)]


def panel(spark, *rows):
    return spark.createDataFrame([r for group in rows for r in group], SALES)


def node(spark, values):
    return spark.createDataFrame([(12, "x", d, v) for d, v in enumerate(values, 1)],
                                 "level_id int, name string, d int, value double")


@pytest.mark.parametrize("values, expected", [
    ([1.0, None, 4.0, 6.0], 6.5),  # the gap is bridged
    ([5.0, 5.0, 5.0], 0.0),
    ([None, 7.0], None),  # one value only
    ([None, None], None),
])
def test_scale(spark, values, expected):
    assert scoring.scale(node(spark, values)).first()["scale"] == expected


def test_constant_node_is_unscored(spark):
    row = spark.createDataFrame([(2.0, 0.0)], "mse double, scale double") \
        .select(scoring.rmsse().alias("r")).first()
    assert row["r"] is None


def test_sum_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("b", None), ("c", 2.0)],
                               "k string, x double")
    got = {r["k"]: (r["s"], r["l"], r["m"]) for r in df.groupBy("k").agg(
        strict_sum("x").alias("s"), lenient_sum("x").alias("l"), strict_avg("x").alias("m")).collect()}
    assert got == {"a": (None, 1.0, None), "b": (None, 0.0, None), "c": (2.0, 2.0, 2.0)}


def test_weights_and_levels(spark):
    rev = panel(spark, sales_rows([30.0], store="s1"), sales_rows([10.0], store="s2")) \
        .withColumnRenamed("sales", "revenue").drop("d")
    w = scoring.weights12(rev)
    by_node = {(r["level_id"], r["name"]): r["weight"] for r in w.collect()}
    assert by_node[12, "i_s1"] == pytest.approx(0.75 / 12)
    assert by_node[12, "i_s2"] == pytest.approx(0.25 / 12)
    assert by_node[1, "Total"] == pytest.approx(1 / 12)
    sums = w.groupBy("level_id").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == len(LEVELS) and all(r["w"] == pytest.approx(1 / 12) for r in sums)


def test_rollup_null_rules(spark):
    cells = panel(spark, sales_rows([1.0, None], store="s1"), sales_rows([2.0, None], store="s2"),
                  sales_rows([None, 4.0], item="j", store="s1"))
    def total(rule, bottom=None):
        nodes = hierarchy.rollup12(cells, "sales", rule, bottom)
        return {(r["level_id"], r["name"], r["d"]): r["sales"] for r in nodes.collect()}
    lenient, strict = total("lenient", "strict"), total("strict")
    assert lenient[1, "Total", 1] == 3.0 and lenient[1, "Total", 2] == 4.0
    assert lenient[12, "i_s1", 2] is None and lenient[10, "i", 2] == 0.0
    assert strict[1, "Total", 1] is None and strict[10, "i", 1] == 3.0
    assert strict[11, "a_j", 2] == 4.0


def test_duplicate_cells_and_one_hot_series(spark):
    """Several rows per cell are summed; a series with most rows changes nothing."""
    rows = sales_rows([1.0] * 3) * 500 + sales_rows([2.0] * 3, store="z")
    nodes = hierarchy.rollup12(panel(spark, rows), "sales", "strict")
    got = {(r["level_id"], r["name"]): r["sales"] for r in nodes.where("d = 2").collect()}
    assert got[12, "i_s"] == 500.0 and got[1, "Total"] == 502.0


def test_perfect_forecast_scores_zero(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    train = panel(spark, sales_rows(values, store="s1"), sales_rows([2.0, 7.0, 1.0, 8.0, 2.0], store="s2"))
    actual = train.where("d > 3").select(*KEYS, (F.col("d") - 3).alias("h"), "sales")
    fc = actual.select("id", "h", F.col("sales").alias("yhat"))
    nodes = hierarchy.rollup12(train.where("d <= 3").withColumnRenamed("sales", "value"), "value", "lenient")
    w = scoring.weights12(train.groupBy(*KEYS).agg(F.sum("sales").alias("revenue")))
    scores = scoring.node_scores(fc, actual, nodes, w)
    assert scoring.wrmsse(scores).first().asDict() == {"wrmsse": 0.0, "unscored_nodes": 0}
    missing = scoring.node_scores(fc.where("h = 1"), actual, nodes, w)
    assert scoring.wrmsse(missing).first()["wrmsse"] is None


@pytest.mark.parametrize("variant, factor", [("croston", 1.0), ("sba", 0.95), ("sbj", 1 - 0.1 / 1.9)])
def test_croston(spark, variant, factor):
    rows = intermittent.croston(panel(spark, sales_rows([0.0, 2.0, 0.0, 3.0])), 3, 0.1, variant).collect()
    assert [r["h"] for r in rows] == [1, 2, 3]
    assert all(r["yhat"] == pytest.approx(1.05 * factor) for r in rows)


def test_all_zero_series(spark):
    zero = panel(spark, sales_rows([0.0, 0.0, 0.0]))
    assert intermittent.croston(zero, 1).first()["yhat"] == 0.0
    assert series.normalize(zero).first()["sales"] is None


def _grid_by_hand(ys, alpha, cost):
    size = gap = None
    since, loss, total = 1.0, 0.0, 0.0
    for n, y in enumerate(ys, 1):
        total += y
        if size is not None:
            e = (y if cost in ("mse", "mae") else total / n) - size / gap
            loss += e * e if cost in ("mse", "msr") else abs(e)
        if y > 0:
            size, gap = (y, since) if size is None else (size + alpha * (y - size), gap + alpha * (since - gap))
            since = 1.0
        else:
            since += 1
    return loss, size / gap


@pytest.mark.parametrize("cost", intermittent.COSTS)
def test_grid_search(spark, cost):
    ys = [0.0, 3.0, 0.0, 0.0, 5.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 4.0]
    got = intermittent.smoothing_level(panel(spark, sales_rows(ys)), "grid", cost=cost).first()
    loss, alpha = min((_grid_by_hand(ys, a, cost)[0], a) for a in intermittent.ALPHA_GRID)
    assert got["alpha_size"] == got["alpha_gap"] == alpha
    assert got["level"] == pytest.approx(_grid_by_hand(ys, alpha, cost)[1])
    free = intermittent.smoothing_level(panel(spark, sales_rows(ys)), "grid", cost=cost, separate=True).first()
    assert free["level"] > 0


def test_embed(spark):
    rows = lags.embed(panel(spark, sales_rows([1.0, 2.0, 3.0, 4.0])), 2).orderBy("d").collect()
    assert [(r["y"], r["lags"]) for r in rows] == [(3.0, [2.0, 1.0]), (4.0, [3.0, 2.0])]
    assert lags.embed(panel(spark, sales_rows([1.0, 2.0])), 2).count() == 0


def test_recursion(spark):
    frame = spark.createDataFrame([("x", h, [1.0, 2.0], 1.0) for h in (1, 2, 3)],
                                  "id string, h int, lags array<double>, mean double")
    rows = forecast_fixed(*split_frame(frame), [0.5, 0.2], {}, Design(2)).orderBy("h").collect()
    assert [r["yhat"] for r in rows] == pytest.approx([0.9, 0.65, 0.505])


def test_normalize_round_trip(spark):
    sales = panel(spark, sales_rows([1.0, 5.0, 3.0]), sales_rows([2.0, 2.0, 8.0], store="t"))
    scaled = series.normalize(sales).select("id", F.col("d").alias("h"), F.col("sales").alias("yhat"))
    back = series.denormalize(scaled, series.series_mean(sales))
    want = {(r["id"], r["d"]): r["sales"] for r in sales.collect()}
    assert all(r["yhat"] == pytest.approx(want[r["id"], r["h"]]) for r in back.collect())


def test_ensemble_needs_all_models(spark):
    a = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 4.0)], "id string, h int, yhat double")
    b = spark.createDataFrame([("x", 1, 4.0)], "id string, h int, yhat double")
    got = {r["h"]: r["yhat"] for r in series.ensemble_mean([a, b]).collect()}
    assert got == {1: 3.0, 2: None}


def test_holdout_is_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    for n in (0, 1, 137, 1000, 2000):
        sample, rest = sampling.holdout(df, n, 7, ["id"])
        again, _ = sampling.holdout(df.repartition(5), n, 7, ["id"])
        ids = {r["id"] for r in sample.collect()}
        assert len(ids) == min(n, 1000) and ids == {r["id"] for r in again.collect()}
        assert ids.isdisjoint({r["id"] for r in rest.collect()})
        assert rest.count() == 1000 - len(ids)


def test_positions_across_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(7)
    rows = with_position(df, [F.col("k")]).collect()
    assert all(r["position"] == r["k"] + 1 for r in rows)


def test_sorted_codes(spark):
    df = spark.createDataFrame([("b", "y"), (None, "x"), ("a", "y")], "p string, q string")
    got = sorted(tuple(r) for r in encode_sorted(df, ["p", "q"]).collect())
    assert got == [(0, 0), (1, 1), (2, 1)]


def test_wide_and_long_keep_nulls(spark):
    wide = spark.createDataFrame([("x", 1.0, None)], "id string, d_1 double, d_2 double")
    long = to_long(wide, ["id"], "label", "v")
    assert long.count() == 2
    assert to_wide(long, ["id"], "label", "v", ["d_1", "d_2"]).first().asDict() == wide.first().asDict()


def test_matrix_lines_keep_their_number(spark, tmp_path):
    """Line numbers hold when a file is read in several splits and files are several."""
    for part in range(2):
        text = "\n".join(f"{part * 400 + i},NA,{i}.5" for i in range(400)) + "\n"
        (tmp_path / f"part-{part}.txt").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        long = readers.read_series_matrix(spark, str(tmp_path))
        rows = long.where("d = 1").collect()
        assert long.rdd.getNumPartitions() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 800 and all(r["series_no"] == r["sales"] + 1 for r in rows)
    assert long.where("d = 2 and sales is null").count() == 800


def test_clusters_file(spark, tmp_path):
    (tmp_path / "clusters.txt").write_text("0 2\n1  3 \n")
    got = sorted(tuple(r) for r in readers.read_clusters(spark, str(tmp_path / "clusters.txt")).collect())
    assert got == [(1, 1), (1, 3), (2, 2), (2, 4)]


def test_partition_overwrite_replaces_one_part(spark, tmp_path):
    path = str(tmp_path / "fc")
    frame = lambda c, v: spark.createDataFrame([(c, v)], "cluster_id int, yhat double")
    for c, v in ((1, 1.0), (2, 2.0), (1, 9.0)):
        writers.write_forecasts(frame(c, v), path)
    assert {r["cluster_id"]: r["yhat"] for r in spark.read.parquet(path).collect()} == {1: 9.0, 2: 2.0}
