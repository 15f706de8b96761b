"""Feature layout shared by every model: lags, numeric columns, one-hot factors.

The factor levels are listed once (from the calendar and the series keys), so training
and test rows line up by construction; a level never listed contributes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_FACTORS = (
    "weekday_flag", "month", "snap", "wday", "day",
    "event_name_1", "event_name_2", "event_type_1", "event_type_2",
)


def factor_levels(df: DataFrame, factors: list[str]) -> dict[str, list[str]]:
    """Sorted distinct levels (as text) of each factor: the columns of the design.

    The combinations that occur are made distinct first, so rows are not multiplied by factors.
    """
    pairs = F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in factors
    ])
    found = df.select(*factors).distinct().select(F.explode(pairs).alias("p")).select("p.f", "p.v") \
        .where("v is not null").distinct()
    levels: dict[str, list[str]] = {f: [] for f in factors}
    for row in found.collect():
        levels[row["f"]].append(row["v"])
    for values in levels.values():
        values.sort(key=_natural)
    return levels


def _natural(text: str):
    return (0, float(text), "") if text.lstrip("-").isdigit() else (1, 0.0, text)


def _texts(levels: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in levels]).cast("array<string>")


def _one_hot(value: Column, levels: list[str]) -> Column:
    shown = _texts(levels)
    return F.transform(shown, lambda v: F.when(v == value, 1.0).otherwise(0.0))


@dataclass(frozen=True)
class Design:
    """Columns of the design matrix, in order: intercept, lags, numeric, factor levels."""

    n_lags: int
    factors: dict[str, list[str]] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()
    intercept: bool = False
    drop_first: bool = False
    aliased: tuple[str, ...] = ()

    def shown_levels(self, factor: str) -> list[str]:
        levels = self.factors[factor]
        levels = levels[1:] if self.drop_first else levels
        return [v for v in levels if f"{factor}={v}" not in self.aliased]

    @property
    def names(self) -> list[str]:
        return [
            *(["intercept"] if self.intercept else []),
            *[f"Lag{k}" for k in range(1, self.n_lags + 1)],
            *self.numeric,
            *[f"{f}={v}" for f in self.factors for v in self.shown_levels(f)],
        ]

    @property
    def size(self) -> int:
        return len(self.names)

    # -- JVM side -----------------------------------------------------------------

    def numeric_array(self) -> Column:
        values = [F.col(c).cast("double") for c in self.numeric]
        return F.array(*values).cast("array<double>")

    def lag_array(self) -> Column:
        return F.col("lags") if self.n_lags else F.array().cast("array<double>")

    def values(self) -> Column:
        """All columns but the intercept as one array<double>."""
        parts = [self.lag_array(), self.numeric_array()]
        for f in self.factors:
            parts.append(_one_hot(F.col(f).cast("string"), self.shown_levels(f)))
        return F.concat(*parts)

    def vector(self) -> Column:
        """The same as an ML vector, for MLlib estimators that add their own intercept."""
        return array_to_vector(self.values())

    def codes(self) -> Column:
        """Factor values as positions in their shown levels (0 = none)."""
        positions = []
        for f in self.factors:
            at = F.array_position(_texts(self.shown_levels(f)), F.col(f).cast("string"))
            positions.append(F.coalesce(at, F.lit(0)))
        return F.array(*positions).cast("array<int>")

    def packed_columns(self) -> list[Column]:
        return [
            self.lag_array().alias("lags"),
            self.numeric_array().alias("numeric"),
            self.codes().alias("codes"),
        ]

    def packed(self, df: DataFrame, *others: str) -> DataFrame:
        """Compact row form for numpy: y, lags, numeric values and factor codes."""
        return df.select(*others, F.col("y").cast("double").alias("y"), *self.packed_columns())

    # -- numpy side (inside tasks) ------------------------------------------------

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """Design matrix of one Arrow batch of packed rows."""
        n = batch.num_rows
        x = np.zeros((n, self.size))
        at = 0
        if self.intercept:
            x[:, 0] = 1.0
            at = 1
        for name, width in (("lags", self.n_lags), ("numeric", len(self.numeric))):
            if width:
                flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                x[:, at:at + width] = flat.reshape(n, width)
                at += width
        if self.factors:
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False)
            codes = codes.reshape(n, len(self.factors))
            for j, f in enumerate(self.factors):
                hit = np.nonzero(codes[:, j])[0]
                x[hit, at + codes[hit, j] - 1] = 1.0
                at += len(self.shown_levels(f))
        return x

    # -- coefficients -------------------------------------------------------------

    def split(self, beta: np.ndarray) -> tuple[list[float], dict[str, float]]:
        """Lag coefficients, and the others by column name."""
        first = 1 if self.intercept else 0
        lags = [float(b) for b in beta[first:first + self.n_lags]]
        rest = {
            name: float(b) for i, (name, b) in enumerate(zip(self.names, beta))
            if not first <= i < first + self.n_lags
        }
        return lags, rest

    def external_effect(self, coefficients: Column) -> Column:
        """Linear predictor without the lags, from a map of named coefficients."""
        def of(name: Column) -> Column:
            return F.coalesce(F.try_element_at(coefficients, name), F.lit(0.0))

        effect = of(F.lit("intercept")) if self.intercept else F.lit(0.0)
        for c in self.numeric:
            effect = effect + of(F.lit(c)) * F.col(c)
        for f in self.factors:
            effect = effect + of(F.concat(F.lit(f"{f}="), F.col(f).cast("string")))
        return effect


def default_design(calendar: DataFrame, n_lags: int, *, statics: DataFrame | None = None,
                   static_factors: tuple[str, ...] = (), numeric: tuple[str, ...] = (),
                   calendar_factors: tuple[str, ...] = CALENDAR_FACTORS,
                   intercept: bool = False, drop_first: bool = False) -> Design:
    """Design over calendar factors plus static series factors."""
    from tallycast.operators.joins import calendar_features, snap_states

    days = calendar_features(calendar)
    from_calendar = [f for f in calendar_factors if f != "snap"]
    levels = factor_levels(days, from_calendar)
    if "snap" in calendar_factors:
        flags = F.explode(F.array(*[F.col(f"`snap_{s}`") for s in snap_states(calendar)]))
        levels.update(factor_levels(days.select(flags.alias("snap")), ["snap"]))
    if static_factors:
        levels.update(factor_levels(statics, list(static_factors)))
    ordered = {f: levels[f] for f in (*calendar_factors, *static_factors)}
    return Design(n_lags, ordered, numeric, intercept, drop_first)
