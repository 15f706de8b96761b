"""Pooled least squares from Gram matrices.

Every task turns its Arrow batches into partial sums of [X y]'[X y] per group, so the
rows of a cluster never meet in one task, however large the cluster. Only the sums are
shuffled, one Gram row per record, and added on the JVM; the final solve sees p + 1 rows
of p + 1 numbers per group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.models.design import Design

COEFFICIENTS = "lag_beta array<double>, ext_beta map<string,double>, n_rows double"
# Partial sums held by a task before they are passed on.
_FLUSH_BYTES = 256 << 20
# Relative eigenvalue below which a direction of X'X counts as absent.
_RANK_TOL = 1e-12


def gram(rows: DataFrame, design: Design, by: str | None = None) -> DataFrame:
    """(group, i, row): rows of [X y]'[X y] per group; row p is [y'X y'y]."""
    grouped = rows.withColumn("_g", F.col(by).cast("string") if by else F.lit("all"))
    packed = design.packed(grouped, "_g")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for g, m in sums.items():
                yield pa.RecordBatch.from_pydict(
                    {"_g": [g] * len(m), "i": list(range(len(m))), "row": list(m)},
                    schema=pa.schema([("_g", pa.string()), ("i", pa.int32()),
                                      ("row", pa.list_(pa.float64()))]),
                )
            sums.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.column_stack([design.matrix(batch), batch.column("y").to_numpy()])
            groups = np.asarray(batch.column("_g").to_pylist())
            for g in np.unique(groups):
                part = a[groups == g]
                sums[g] = sums.get(g, 0.0) + part.T @ part
            if sum(m.nbytes for m in sums.values()) > _FLUSH_BYTES:
                yield from emit()
        yield from emit()

    partials = packed.mapInArrow(partial, "_g string, i int, row array<double>")
    summed = partials.groupBy("_g", "i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return summed.select("_g", "i", vector_to_array("row").alias("row"))


def solve_gram(m: np.ndarray) -> np.ndarray:
    """Minimum-norm least-squares coefficients from one [X y]'[X y]."""
    xtx, xty = m[:-1, :-1], m[:-1, -1]
    values, vectors = np.linalg.eigh((xtx + xtx.T) / 2)
    keep = values > _RANK_TOL * max(values[-1], 0.0)
    v = vectors[:, keep]
    return v @ ((v.T @ xty) / values[keep])


def drop_aliased(rows: DataFrame, design: Design, tol: float = 1e-9) -> Design:
    """Leave out factor levels that are combinations of earlier columns.

    Needed where a solver wants full rank: one Gram pass finds, column by column, what is
    left after projecting on the columns kept so far.
    """
    pieces = gram(rows, design).collect()  # p + 1 rows of p + 1 numbers
    m = np.vstack([r["row"] for r in sorted(pieces, key=lambda r: r["i"])])[:-1, :-1]
    size = np.sqrt(np.maximum(np.diag(m), 0.0))
    unit = m / np.outer(np.where(size > 0, size, 1.0), np.where(size > 0, size, 1.0))
    left, aliased = unit.copy(), []
    for j, name in enumerate(design.names):
        if left[j, j] > tol:
            left = left - np.outer(left[:, j], left[j, :]) / left[j, j]
        elif "=" in name:
            aliased.append(name)
    return replace(design, aliased=tuple(aliased))


def fit_ols(rows: DataFrame, design: Design, by: str | None = None) -> DataFrame:
    """Least squares per group -> (by, lag_beta, ext_beta, n_rows).

    ``n_rows`` is exact when the design has an intercept and null otherwise.
    """
    has_intercept = design.intercept

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.vstack(pdf.sort_values("i")["row"].to_numpy())
        lags, rest = design.split(solve_gram(m))
        n = float(m[0, 0]) if has_intercept else None
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "lag_beta": [lags],
                             "ext_beta": [rest], "n_rows": [n]})

    solved = gram(rows, design, by).groupBy("_g").applyInPandas(
        solve, f"_g string, {COEFFICIENTS}"
    )
    if by is None:
        return solved.drop("_g")
    kind = rows.schema[by].dataType
    return solved.select(F.col("_g").cast(kind).alias(by), "lag_beta", "ext_beta", "n_rows")


def fit_linear_regression(rows: DataFrame, design: Design):
    """Global pooled regression by MLlib's normal-equation solver; the design needs
    ``intercept`` and ``drop_first``. Returns the fitted MLlib model."""
    data = rows.select("y", design.vector().alias("features"))
    return LinearRegression(labelCol="y", solver="normal").fit(data)


def mllib_coefficients(model, design: Design) -> tuple[list[float], dict[str, float]]:
    """Lag and named coefficients of an MLlib linear or generalised linear model."""
    beta = np.concatenate([[model.intercept], model.coefficients.toArray()])
    return design.split(beta)
