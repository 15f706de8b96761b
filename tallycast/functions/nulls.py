"""The null rules of sums and means.

``strict``: one missing value makes the result missing.
``lenient``: missing values are skipped; an all-missing sum is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _complete(c: Column) -> Column:
    return F.count(F.lit(1)) == F.count(c)


def strict_sum(c: Column | str) -> Column:
    c = _col(c)
    return F.when(_complete(c), F.sum(c))


def lenient_sum(c: Column | str) -> Column:
    total = F.sum(_col(c))
    return F.coalesce(total, F.lit(0).cast("double"))


def strict_avg(c: Column | str) -> Column:
    c = _col(c)
    return F.when(_complete(c), F.avg(c))


def lenient_avg(c: Column | str) -> Column:
    return F.avg(_col(c))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that yields null, not an error, for a zero denominator."""
    return F.try_divide(_col(num), _col(den))


def clamp_nonneg(c: Column | str) -> Column:
    """Negative forecasts become 0; a missing one stays missing."""
    c = _col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)
