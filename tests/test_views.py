"""The demand view on hand-made orders, and plans that must stay narrow."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallycast.models.design import Design
from tallycast.models.recursion import forecast_fixed, unforecast
from tallycast.operators import filters, lags, placement, sampling, scoring
from tallycast.plans import evaluate, forecast, score
from tallycast.sources import orderbook as ob
from tallycast.sources import writers


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Four lines, the first in 1994 and the last in 2002."""
    root = str(tmp_path_factory.mktemp("orders"))
    lines = [(1, 1, datetime(1994, 3, 5), 2.0, 20.0), (1, 1, datetime(1995, 6, 1), 3.0, 33.0),
             (2, 1, datetime(2002, 1, 20), 5.0, 10.0), (1, 1, datetime(2002, 2, 3), 4.0, 48.0)]
    tables = {
        "lineitem": (lines, "l_partkey int, l_suppkey int, l_shipdate timestamp, l_quantity double, l_extendedprice double"),
        "part": ([(1, "LARGE", "Brand#11"), (2, "SMALL", "Brand#12")], "p_partkey int, p_type string, p_brand string"),
        "supplier": ([(1, 7)], "s_suppkey int, s_nationkey int"),
        "nation": ([(7, "KENYA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def test_no_order_is_outside_the_view(spark, orders):
    monthly = ob.monthly_view(spark, orders)
    assert monthly.last == 96
    got = monthly.sales().groupBy("id").agg(F.sum("sales").alias("s"), F.count("*").alias("n")).collect()
    assert sorted((r["s"], r["n"]) for r in got) == [(5.0, 96), (9.0, 96)]
    assert monthly.cells.agg(F.min("d"), F.max("d")).first() == (1, 96)
    months = ob.monthly_calendar(spark, orders).orderBy("d").collect()
    assert (str(months[0]["date"]), str(months[-1]["date"])) == ("1994-03-01", "2002-02-01")
    daily = ob.daily_view(spark, orders)
    assert daily.sales().agg(F.sum("sales")).first()[0] == 14.0
    assert daily.last == (datetime(2002, 2, 3) - datetime(1994, 3, 5)).days + 1


def test_days_without_sales_have_the_newest_price(spark, orders):
    daily = ob.daily_view(spark, orders)
    rows = {(r["id"], r["d"]): r["price"] for r in daily.daily_prices().collect()}
    large = {d: p for (i, d), p in rows.items() if i.startswith("LARGE")}
    small = {d: p for (i, d), p in rows.items() if i.startswith("SMALL")}
    second = (datetime(1995, 6, 1) - datetime(1994, 3, 5)).days + 1
    assert sorted(large) == list(range(1, daily.last + 1))
    assert (large[1], large[second - 10], large[second], large[daily.last]) == (10.0, 10.0, 11.0, 12.0)
    # nothing before the launch
    launch = (datetime(2002, 1, 20) - datetime(1994, 3, 5)).days + 1
    assert min(small) == (launch - 1) // 7 * 7 + 1 and set(small.values()) == {2.0}


def test_recursion_shuffles_no_lags_per_step(spark, sf_dir):
    view = ob.daily_view(spark, sf_dir, staged=True)
    parts = lags.future_parts(view.sales(), view.calendar(), 28, 28)
    fc = forecast_fixed(*parts, [0.1] * 28, {}, Design(28), scaled=True)
    plan = fc._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) (?:Exchange|ReusedExchange)[^\n]*\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert moved and not any("lags#" in m and re.search(r"\bh#", m) for m in moved)


def test_short_series_keep_their_steps(spark, sf_dir):
    view = ob.daily_view(spark, sf_dir, staged=True)
    first = view.cells.agg(F.min("id")).first()[0]
    sales = view.sales().where((F.col("id") != first) | (F.col("d") > view.last - 5))
    fc = forecast_fixed(*lags.future_parts(sales, view.calendar(), 28, 28), [0.1] * 28, {}, Design(28))
    assert fc.where(F.col("id") == first).count() == 28
    assert [r["id"] for r in unforecast(fc).collect()] == [first]


def test_holdout_of_repeated_rows_is_exact(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_ORDERED_ROWS", 2)
    df = spark.createDataFrame([("a", 1)] * 40 + [("b", 2)] * 3 + [("c", 3)], "id string, v int")
    for n in (1, 7, 41, 44):
        sample, rest = sampling.holdout(df, n, 3, ["id"])
        assert sample.count() == n and rest.count() == 44 - n
        both = sample.unionByName(rest).groupBy("id").count().collect()
        assert sorted((r["id"], r["count"]) for r in both) == [("a", 40), ("b", 3), ("c", 1)]


def test_holdout_of_every_group(spark):
    rows = [("big", f"s{i}", i) for i in range(900)] + [("small", f"t{i}", i) for i in range(20)] + [(None, "u", 1)]
    df = spark.createDataFrame(rows, "g string, id string, d int")
    got = sampling.holdout_by(df, "g", 50, 5, ["id", "d"], share=5)
    counts = {(r["g"], r["held"]): r["count"] for r in got.groupBy("g", "held").count().collect()}
    assert counts == {("big", True): 50, ("big", False): 850, ("small", True): 4, ("small", False): 16, (None, False): 1}
    again = sampling.holdout_by(df.repartition(7), "g", 50, 5, ["id", "d"], share=5)
    assert sorted(r["id"] for r in got.where("held").collect()) == sorted(r["id"] for r in again.where("held").collect())


def test_a_large_group_takes_its_share_of_the_tasks(spark):
    """One group has 40 % of the rows; no task holds two groups or much more than its share."""
    df = spark.range(20_000).select(F.when(F.col("id") < 8000, 0).otherwise(F.col("id") % 30 + 1).cast("int").alias("g"), "id")
    placed = placement.deal(df, df.groupBy("g").count(), "g", "id", 50).withColumn("task", F.spark_partition_id())
    tasks = placed.groupBy("task").agg(F.count_distinct("g").alias("groups"), F.count("*").alias("n")).collect()
    assert placed.count() == 20_000 and max(t["groups"] for t in tasks) == 1
    assert placed.where("g = 0").select("task").distinct().count() == 20 and max(t["n"] for t in tasks) < 2 * 400


def test_off_sale_before_the_launch_only(spark, orders):
    """Months without a sale keep their zero once an item was on sale; withdrawal is optional."""
    view = ob.monthly_view(spark, orders)
    for withdrawn, zeros in ((False, {"LARGE": 93, "SMALL": 1}), (True, {"LARGE": 93, "SMALL": 0})):
        masked = filters.mask_off_sale(view.sales(), view.calendar(), view.prices(), withdrawn)
        got = {r["cat_id"]: r["z"] for r in masked.groupBy("cat_id").agg(
            F.count_if(F.col("sales") == 0).alias("z")).collect()}
        assert got == zeros
    missing = masked.where("sales is null").groupBy("cat_id").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()
    assert [(r["cat_id"], r["n"]) for r in missing] == [("SMALL", 95)]
    nodes = score.train_hierarchy(view.sales(), view.calendar(), view.prices())
    scales = {r["name"]: r["scale"] for r in scoring.scale(nodes).where("level_id = 4").collect()}
    assert scales["LARGE"] > 0


def test_a_second_score_reads_stored_inputs_only(spark, sf_dir, tmp_path):
    view = ob.monthly_view(spark, sf_dir, staged=True)
    sales = view.sales()
    args = (sales, view.calendar(), view.prices(), 77, 6, "lenient", str(tmp_path / "inputs"))
    fc = forecast.naive(sales, 77, 6)
    first = score.stored_inputs(*args, "a").score(fc)
    whole = score.score_forecasts(fc, sales, view.calendar(), view.prices(), 77, 6, "lenient")
    key = lambda rows: sorted(((r["level_id"], r["name"]), r["wrmsse"]) for r in rows if r["wrmsse"] is not None)
    assert [k for k, _ in key(first.collect())] == [k for k, _ in key(whole.collect())]
    assert [w for _, w in key(first.collect())] == pytest.approx([w for _, w in key(whole.collect())])

    path = str(tmp_path / "forecast")
    forecast.mean_forecast(sales, 77, 6).write.parquet(path)
    second = score.stored_inputs(*args, "a").score(spark.read.parquet(path))
    assert {f.split("/inputs/")[0] if "/inputs/" in f else f.rsplit("/", 1)[0] for f in second.inputFiles()} \
        == {f"file://{tmp_path}", f"file://{path}"}
    assert second.where("wrmsse is not null").count() > 0
    # other data or another cut-off has inputs of its own
    score.stored_inputs(*args, "b")
    assert len(list((tmp_path / "inputs").iterdir())) == 2


def test_reasons_for_missing_values(spark, sf_dir):
    view = ob.daily_view(spark, sf_dir, staged=True)
    sales = view.sales()
    ids = sorted(r["id"] for r in sales.select("id").distinct().collect())
    gaps = sales.where(~F.col("id").isin(ids[:3]) | (F.col("d") > view.last - 20)).withColumn(
        "sales", F.when(~((F.col("id") == ids[3]) & (F.col("d") == view.last - 2)), F.col("sales")))
    members = view.clusters().where(~F.col("id").isin(ids[4:6]))
    fc = forecast.cluster_forecast(gaps, view.calendar(), members, 28, 28).where(F.col("id") != ids[6])
    got = {r["id"]: (r["steps"], r["values"], r["reason"]) for r in evaluate.coverage(gaps, fc, 28, members).collect()}
    want = dict.fromkeys(ids, (28, 28, None)) | dict.fromkeys(ids[:3], (28, 0, "short history")) \
        | {ids[3]: (28, 0, "gap in the lags"), ids[6]: (0, 0, "not forecast")} \
        | dict.fromkeys(ids[4:6], (28, 0, "no cluster"))
    assert got == want


def test_only_missing_pieces_are_written(spark, tmp_path):
    path, df, made = str(tmp_path / "out"), spark.range(40).selectExpr("id", "id % 5 AS piece"), []

    def make(some):
        made.append(list(some))
        if len(made) == 2:
            raise InterruptedError
        return df.where(F.col("piece").isin(some)).withColumn("call", F.lit(len(made)))

    with pytest.raises(InterruptedError):
        writers.write_missing(spark, path, range(5), make, by="piece", at_once=2)
    # leftovers of the job that broke off are replaced
    df.where("piece = 2").withColumn("call", F.lit(-1)).write.mode("append").partitionBy("piece").parquet(path)
    assert writers.finished_pieces(spark, path) == {"0", "1"}
    assert writers.write_missing(spark, path, range(5), make, by="piece", at_once=2) == [2, 3, 4]
    assert writers.write_missing(spark, path, range(5), make, by="piece") == []
    calls = {r["piece"]: r["call"] for r in spark.read.parquet(path).select("piece", "call").distinct().collect()}
    assert calls == {0: 1, 1: 1, 2: 3, 3: 3, 4: 4} and spark.read.parquet(path).count() == 40


def test_holdout_rmse_counts_missing_values(spark):
    held = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 0.0)], "id string, d int, y double")
    made = spark.createDataFrame([("m", "a", 1, 2.0), ("m", "a", 2, 7.0), ("m", "b", 1, None), ("n", "b", 1, 1.0),
                                  ("n", "z", 1, 1.0)], "model string, id string, d int, prediction double")
    got = {r["model"]: (r["n"], r["missing"], round(r["rmse"], 9)) for r in evaluate.holdout_rmse(held, made).collect()}
    assert got == {"m": (2, 1, round(4.5 ** 0.5, 9)), "n": (1, 2, 1.0)}
