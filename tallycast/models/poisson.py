"""Poisson and zero-inflated Poisson regression with log link."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.models.design import Design
from tallycast.models.recursion import ETA_LIMIT

_RIDGE = 1e-8


def fit_poisson(rows: DataFrame, design: Design, max_iter: int = 50, tol: float = 1e-10):
    """Poisson GLM by MLlib; the design needs ``intercept`` and ``drop_first``.

    The solver reads its input once per iteration, so the assembled rows are kept.
    """
    glm = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="y", maxIter=max_iter, tol=tol
    )
    data = rows.select("y", design.vector().alias("features"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return glm.fit(data)
    finally:
        data.unpersist()


@dataclass
class ZipModel:
    """Count part (log link) and zero part (logit link) of a zero-inflated Poisson."""

    design: Design
    zero_design: Design
    count_beta: np.ndarray
    zero_beta: np.ndarray
    log_likelihood: list[float] = field(default_factory=list)

    def count_coefficients(self):
        return self.design.split(self.count_beta)

    def zero_coefficients(self):
        return self.zero_design.split(self.zero_beta)


def _packed_pair(rows: DataFrame, count: Design, zero: Design) -> DataFrame:
    """Packed rows of both designs side by side; they share the lags."""
    if count.n_lags != zero.n_lags:
        raise ValueError("both parts must use the same number of lags")
    zero_cols = [zero.numeric_array().alias("z_numeric"), zero.codes().alias("z_codes")]
    return rows.select(F.col("y").cast("double").alias("y"), *count.packed_columns(), *zero_cols)


def _em_sums(packed: DataFrame, count: Design, zero: Design, b: np.ndarray, g: np.ndarray):
    """One pass: log-likelihood, score and information of both weighted parts, and the information
    that is missing because the source of a zero is unknown (of both parts together)."""
    p, q = len(b), len(g)
    width = 1 + p + p * p + q + q * q + (p + q) ** 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy()
            x = count.matrix(batch)
            z = zero.matrix(batch.select(["lags", "z_numeric", "z_codes"])
                            .rename_columns(["lags", "numeric", "codes"]))
            eta, zeta = np.clip(x @ b, -ETA_LIMIT, ETA_LIMIT), np.clip(z @ g, -ETA_LIMIT, ETA_LIMIT)
            lam, pi = np.exp(eta), 1 / (1 + np.exp(-zeta))
            at_zero = y == 0
            p_zero = pi + (1 - pi) * np.exp(-lam)
            r = np.where(at_zero, pi / p_zero, 0.0)
            # without log y!, which no parameter changes
            ll = np.where(at_zero, np.log(p_zero), np.log1p(-pi) + y * eta - lam)
            w, v = (1 - r) * lam, pi * (1 - pi)
            both = np.column_stack([x * lam[:, None], z])
            total += np.concatenate([
                [ll.sum()], x.T @ ((1 - r) * (y - lam)), ((x * w[:, None]).T @ x).ravel(),
                z.T @ (r - pi), ((z * v[:, None]).T @ z).ravel(),
                ((both * (r * (1 - r))[:, None]).T @ both).ravel(),
            ])
        yield pa.RecordBatch.from_pydict(
            {"i": np.arange(width, dtype=np.int32), "v": total},
            schema=pa.schema([("i", pa.int32()), ("v", pa.float64())]),
        )

    sums = packed.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    s = np.zeros(width)
    for row in sums.collect():  # width depends on the design only
        s[row["i"]] = row["v"]
    ll, s = s[0], s[1:]
    bg, bh, s = s[:p], s[p:p + p * p].reshape(p, p), s[p + p * p:]
    gg, gh, s = s[:q], s[q:q + q * q].reshape(q, q), s[q + q * q:]
    return ll, bg, bh, gg, gh, s.reshape(p + q, p + q)


def _newton(hess: np.ndarray, grad: np.ndarray) -> np.ndarray:
    return np.linalg.solve(_ridged(hess), grad)


def _ridged(hess: np.ndarray) -> np.ndarray:
    """With a little of its own diagonal, so that columns of any unit are treated alike."""
    own = np.diag(hess)
    return hess + _RIDGE * np.diag(np.where(own > 0, own, 1.0))


def _directions(state) -> Iterator[np.ndarray]:
    """Steps for both parts: by the observed information where it is positive definite, which ends
    the search in a few passes, else (or if that fails) by the expected one of each part."""
    _, bg, bh, gg, gh, missing = state
    p = len(bg)
    observed = -missing
    observed[:p, :p] += bh
    observed[p:, p:] += gh
    observed = _ridged(observed)
    try:
        np.linalg.cholesky(observed)
        yield np.linalg.solve(observed, np.concatenate([bg, gg]))
    except np.linalg.LinAlgError:
        pass
    yield np.concatenate([_newton(bh, bg), _newton(gh, gg)])


def fit_zip(rows: DataFrame, design: Design, zero_design: Design, max_iter: int = 50,
            tol: float = 1e-6) -> ZipModel:
    """Zero-inflated Poisson by Newton steps on the observed likelihood, or EM steps where that
    has no maximum nearby.

    Each pass returns sums whose number depends on the design only. A step that lowers the
    log-likelihood is halved. Starts from the Poisson fit.
    """
    packed = _packed_pair(rows, design, zero_design).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = fit_poisson(rows, design)
        b = np.concatenate([[start.intercept], start.coefficients.toArray()])
        g = np.zeros(zero_design.size)
        history: list[float] = []
        state = _em_sums(packed, design, zero_design, b, g)
        history.append(state[0])
        for _ in range(max_iter):
            for direction, least in zip(_directions(state), (0.25, 1e-3)):
                step = 1.0
                while True:
                    to_b, to_g = b + step * direction[:len(b)], g + step * direction[len(b):]
                    trial = _em_sums(packed, design, zero_design, to_b, to_g)
                    if trial[0] >= history[-1] or step < least:
                        break
                    step /= 2
                if trial[0] >= history[-1]:
                    break
            if trial[0] < history[-1]:
                break
            b, g, state = to_b, to_g, trial
            history.append(trial[0])
            if abs(history[-1] - history[-2]) <= tol * (abs(history[-2]) + tol):
                break
        return ZipModel(design, zero_design, b, g, history)
    finally:
        packed.unpersist()
