"""Calendar flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKEND = ("Saturday", "Sunday")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_month(date: Column | str) -> Column:
    """Day part of a date or of ISO date text."""
    return F.dayofmonth(F.to_date(_col(date)))


def weekday_flag(weekday: Column | str) -> Column:
    """0 on Saturday and Sunday, else 1."""
    return F.when(_col(weekday).isin(*WEEKEND), 0).otherwise(1)


def weekend_flag(weekday: Column | str) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return F.when(_col(weekday).isin(*WEEKEND), 1).otherwise(0)


def snap_for_state(state: Column | str, states: list[str]) -> Column:
    """The ``snap_<state>`` flag of the row's own state."""
    flag = F.lit(None).cast("int")
    for name in states:
        flag = F.when(_col(state) == name, F.col(f"`snap_{name}`")).otherwise(flag)
    return flag


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.trim(c) != "", c)


def fill_event(column: str) -> Column:
    """A blank or missing event becomes ``no_<column>``."""
    return F.coalesce(blank_to_null(column), F.lit(f"no_{column}"))
