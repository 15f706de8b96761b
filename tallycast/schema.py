"""Column contracts. Every table is long: a new day is a row, never a column."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]

# Hierarchy levels in order; the tuple lists the key columns that name a node.
LEVELS: dict[int, tuple[str, ...]] = {
    1: (),
    2: ("state_id",),
    3: ("store_id",),
    4: ("cat_id",),
    5: ("dept_id",),
    6: ("state_id", "cat_id"),
    7: ("state_id", "dept_id"),
    8: ("store_id", "cat_id"),
    9: ("store_id", "dept_id"),
    10: ("item_id",),
    11: ("state_id", "item_id"),
    12: ("id",),
}
N_LEVELS = len(LEVELS)
TOTAL_NAME = "Total"

_str, _int, _dbl = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


SALES_KEYS = _struct(*[(k, _str) for k in KEYS])
SALES_LONG = _struct(*[(k, _str) for k in KEYS], ("d", _int), ("sales", _dbl))
PRICES = _struct(
    ("store_id", _str), ("item_id", _str), ("wm_yr_wk", _int), ("sell_price", _dbl)
)
NODES = _struct(("level_id", _int), ("name", _str), ("d", _int), ("value", _dbl))
WEIGHTS = _struct(("level_id", _int), ("name", _str), ("weight", _dbl))
FORECASTS = _struct(("id", _str), ("h", _int), ("yhat", _dbl))
CLUSTERS = _struct(("cluster_id", _int), ("series_no", _int))

EVENT_COLUMNS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]


def calendar_schema(states: list[str]) -> T.StructType:
    """Calendar columns; one ``snap_<state>`` flag per state."""
    return _struct(
        ("date", T.DateType()), ("wm_yr_wk", _int), ("weekday", _str), ("wday", _int),
        ("month", _int), ("year", _int), ("d", _str),
        *[(c, _str) for c in EVENT_COLUMNS],
        *[(f"snap_{s}", _int) for s in states],
    )


def wide_sales_schema(days: list[str]) -> T.StructType:
    """Wide sales file: the six keys, then one column per day."""
    return _struct(*[(k, _str) for k in KEYS], *[(d, _dbl) for d in days])
