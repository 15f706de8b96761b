"""Smoothing of intermittent demand and the routing of series by demand class.

Choices fixed here: the first interval counts from the series start, size and interval
start at the first demand, and a series without demand is forecast 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.nulls import clamp_nonneg
from tallycast.operators.lags import series_arrays
from tallycast.operators.series import demand_stats

VARIANTS = ("croston", "sba", "sbj")
COSTS = ("mse", "mae", "msr", "mar")

# Class limits on mean interval and squared variation of sizes.
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49

# Default grid searched when the smoothing constant is left to the data.
ALPHA_GRID = tuple(round(0.05 * k, 2) for k in range(1, 11))


def bias_factor(variant: str, alpha: Column | float) -> Column:
    """Multiplier of the size/interval ratio."""
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return {
        "croston": F.lit(1.0),
        "sba": 1 - alpha / 2,
        "sbj": 1 - alpha / (2 - alpha),
    }[variant]


def _smooth(ys: Column, size_alpha: Column, gap_alpha: Column, variant: str,
            cost: str | None) -> Column:
    """Final (size, gap, since, loss, n, total) state of a series array.

    ``loss`` adds up the one-step errors after the first demand: against the value for
    mse/mae, against the running mean rate for msr/mar.
    """
    start = F.struct(
        F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("gap"),
        F.lit(1.0).alias("since"), F.lit(0.0).alias("loss"),
        F.lit(0.0).alias("n"), F.lit(0.0).alias("total"),
    )
    factor = bias_factor(variant, gap_alpha)

    def step(s: Column, y: Column) -> Column:
        demand, started = y > 0, s["size"].isNotNull()
        size = F.when(demand & started, s["size"] + size_alpha * (y - s["size"])) \
            .when(demand, y).otherwise(s["size"])
        gap = F.when(demand & started, s["gap"] + gap_alpha * (s["since"] - s["gap"])) \
            .when(demand, s["since"]).otherwise(s["gap"])
        since = F.when(demand, F.lit(1.0)).otherwise(s["since"] + 1)
        loss, n, total = s["loss"], s["n"], s["total"]
        if cost:
            n, total = n + 1, total + y
            forecast = factor * s["size"] / s["gap"]
            target = y if cost in ("mse", "mae") else total / n
            err = target - forecast
            err = err * err if cost in ("mse", "msr") else F.abs(err)
            loss = F.when(started, loss + err).otherwise(loss)
        return F.struct(
            size.alias("size"), gap.alias("gap"), since.alias("since"),
            loss.alias("loss"), n.alias("n"), total.alias("total"),
        )

    return F.aggregate(ys, start, step)


def _rate(state: Column, variant: str, alpha: Column) -> Column:
    level = bias_factor(variant, alpha) * state["size"] / state["gap"]
    return F.coalesce(level, F.lit(0.0))


def smoothing_level(sales: DataFrame, alpha: float | str = 0.1, variant: str = "croston",
                    cost: str = "mar", grid: tuple[float, ...] = ALPHA_GRID,
                    separate: bool = False) -> DataFrame:
    """Per series: the flat forecast level and the constants used.

    ``alpha="grid"`` picks the constants with the smallest in-sample cost; ``separate``
    lets sizes and intervals take different ones. The grid is tried inside the series
    row, so it costs no shuffle.
    """
    series = series_arrays(sales, keys=["id"]).select("id", "ys")
    if alpha != "grid":
        a = F.lit(float(alpha))
        state = _smooth(F.col("ys"), a, a, variant, None)
        return series.withColumn("_s", state).select(
            "id", a.alias("alpha_size"), a.alias("alpha_gap"),
            _rate(F.col("_s"), variant, a).alias("level"),
        )
    pairs = [(s, g) for s in grid for g in grid if separate or s == g]
    options = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(g).alias("g")) for s, g in pairs])

    def attempt(o: Column) -> Column:
        state = _smooth(F.col("ys"), o["s"], o["g"], variant, cost)
        return F.struct(state["loss"].alias("loss"), o["s"].alias("s"), o["g"].alias("g"))

    best = series.withColumn("_b", F.array_min(F.transform(options, attempt)))
    final = _smooth(F.col("ys"), F.col("_b.s"), F.col("_b.g"), variant, None)
    return best.withColumn("_s", final).select(
        "id", F.col("_b.s").alias("alpha_size"), F.col("_b.g").alias("alpha_gap"),
        _rate(F.col("_s"), variant, F.col("_b.g")).alias("level"),
    )


def croston(sales: DataFrame, horizon: int = 56, alpha: float | str = 0.1,
            variant: str = "croston", **search) -> DataFrame:
    """Flat forecasts (id, h, yhat) of the chosen variant, never negative."""
    level = smoothing_level(sales, alpha, variant, **search)
    return level.select(
        "id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"),
        clamp_nonneg("level").alias("yhat"),
    )


def classify_sbc(sales: DataFrame) -> DataFrame:
    """Demand class of each series: regular ("croston") or intermittent ("sba")."""
    regular = (F.col("adi") < ADI_LIMIT) & (F.col("cv2") < CV2_LIMIT)
    return demand_stats(sales).withColumn(
        "demand_class", F.when(regular, "croston").otherwise("sba")
    )


def route(sales: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    """Series split by demand class."""
    tagged = sales.join(classes.select("id", "demand_class"), "id")
    return {
        c: tagged.where(F.col("demand_class") == c).drop("demand_class")
        for c in ("croston", "sba")
    }


def route_union(regular: DataFrame, intermittent: DataFrame, classes: DataFrame) -> DataFrame:
    """One forecast table: each series from the model family of its class.

    A series whose family has no forecast for it keeps one row with null step and value.
    """
    def of(fc: DataFrame, name: str) -> DataFrame:
        members = classes.where(F.col("demand_class") == name).select("id")
        return members.join(fc.select("id", "h", "yhat"), "id", "left")

    return of(regular, "croston").unionByName(of(intermittent, "sba"))
