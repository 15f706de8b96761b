"""Query registry and the SQL building blocks shared by the counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL if there is one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# first day of the order book: period 1 everywhere
DAY0 = "(SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)"
KEYS = "id, item_id, dept_id, cat_id, store_id, state_id"

_CTES = {
    # order lines with hierarchy keys
    "lines": """
  SELECT p_type || '_' || p_brand || '_' || n_name AS id, p_type || '_' || p_brand AS item_id,
         p_type || '_' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 5) AS dept_id,
         p_type AS cat_id, n_name AS store_id, r_name AS state_id,
         CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # non-empty monthly cells
    "cells": """
  SELECT id, item_id, dept_id, cat_id, store_id, state_id,
         CAST((year(date) - year(first)) * 12 + month(date) - month(first) + 1 AS INT) AS d,
         sum(quantity) AS sales, CAST(sum(amount) AS DOUBLE) / sum(quantity) AS sell_price
  FROM lines, (SELECT min(CAST(l_shipdate AS DATE)) AS first FROM lineitem) GROUP BY ALL""",
    # dense monthly sales
    "sales": """
  SELECT k.*, CAST(g.d AS INT) AS d, coalesce(c.sales, 0) AS sales, c.sell_price
  FROM (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM cells) k
  CROSS JOIN (SELECT unnest(range(1, max(d) + 1)) AS d FROM cells) g LEFT JOIN cells c ON c.id = k.id AND c.d = g.d""",
    # non-empty daily cells of category x region
    "dcells": """
  SELECT cat_id || '_' || state_id AS id, cat_id AS item_id, cat_id AS dept_id, cat_id,
         state_id AS store_id, state_id, CAST(date - (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + 1 AS INT) AS d,
         sum(quantity) AS sales, CAST(sum(amount) AS DOUBLE) / sum(quantity) AS price
  FROM lines GROUP BY cat_id, state_id, date""",
    # weekly prices of the daily view
    "wprices": """
  SELECT state_id AS store_id, cat_id AS item_id,
         CAST(floor((date - (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)) / 7) AS INT) AS wm_yr_wk,
         CAST(sum(amount) AS DOUBLE) / sum(quantity) AS sell_price
  FROM lines GROUP BY ALL""",
    # price of every day from launch on: the newest week that has one
    "dprices": """
  SELECT k.id, CAST(g.d AS INT) AS d, (SELECT arg_max(w.sell_price, w.wm_yr_wk) FROM wprices w
    WHERE w.store_id = k.store_id AND w.item_id = k.item_id AND w.wm_yr_wk <= floor((g.d - 1) / 7)) AS price
  FROM (SELECT DISTINCT id, store_id, item_id FROM dcells) k
  CROSS JOIN (SELECT unnest(range(1, date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) + 2)) AS d
              FROM lineitem) g""",
    # dense daily sales
    "dsales": """
  SELECT k.*, CAST(g.d AS INT) AS d, coalesce(c.sales, 0) AS sales
  FROM (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM dcells) k
  CROSS JOIN (SELECT unnest(range(1, max(d) + 1)) AS d FROM dcells) g
  LEFT JOIN dcells c ON c.id = k.id AND c.d = g.d""",
    # calendar to 28 days past the newest order
    "calendar": """
  SELECT d, date, CAST(floor((d - 1) / 7) AS INT) AS wm_yr_wk, dayname(date) AS weekday,
         CAST((dayofweek(date) + 1) % 7 + 1 AS INT) AS wday,
         CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
         CASE WHEN month(date) = 12 AND day(date) = 25 THEN 'Christmas'
              WHEN month(date) = 1 AND day(date) = 1 THEN 'NewYear'
              WHEN month(date) = 7 AND day(date) = 4 THEN 'IndependenceDay'
              WHEN month(date) = 2 AND day(date) = 14 THEN 'ValentinesDay' END AS event_name_1,
         CASE WHEN month(date) = 12 AND day(date) = 25 OR month(date) = 1 AND day(date) = 1
                OR month(date) = 7 AND day(date) = 4 THEN 'National'
              WHEN month(date) = 2 AND day(date) = 14 THEN 'Cultural' END AS event_type_1,
         CASE WHEN month(date) = 12 AND day(date) = 25 THEN 'WinterSale'
              WHEN month(date) = 7 AND day(date) = 4 THEN 'SummerSale' END AS event_name_2,
         CASE WHEN month(date) = 12 AND day(date) = 25 OR month(date) = 7 AND day(date) = 4
              THEN 'Cultural' END AS event_type_2,
         CAST(day(date) BETWEEN 1 AND 10 AS INT) AS snap_AFRICA,
         CAST(day(date) BETWEEN 3 AND 12 AS INT) AS snap_AMERICA,
         CAST(day(date) BETWEEN 5 AND 14 AS INT) AS snap_ASIA,
         CAST(day(date) BETWEEN 7 AND 16 AS INT) AS snap_EUROPE,
         CAST(day(date) BETWEEN 9 AND 18 AS INT) AS "snap_MIDDLE EAST"
  FROM (SELECT CAST(d AS INT) AS d, (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + CAST(d - 1 AS INT) AS date
        FROM (SELECT unnest(range(1, n + 29)) AS d
              FROM (SELECT max(CAST(l_shipdate AS DATE)) - (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem) + 1 AS n
                    FROM lineitem)))""",
    # external variables per state and day
    "externals": """
  SELECT c.d, s.state_id, c.month, c.wday, CAST(day(c.date) AS INT) AS day,
         CASE WHEN c.weekday IN ('Saturday', 'Sunday') THEN 0 ELSE 1 END AS weekday_flag,
         coalesce(c.event_name_1, 'no_event_name_1') AS event_name_1,
         coalesce(c.event_type_1, 'no_event_type_1') AS event_type_1,
         coalesce(c.event_name_2, 'no_event_name_2') AS event_name_2,
         coalesce(c.event_type_2, 'no_event_type_2') AS event_type_2,
         CASE s.state_id WHEN 'AFRICA' THEN c.snap_AFRICA WHEN 'AMERICA' THEN c.snap_AMERICA
              WHEN 'ASIA' THEN c.snap_ASIA WHEN 'EUROPE' THEN c.snap_EUROPE
              WHEN 'MIDDLE EAST' THEN c."snap_MIDDLE EAST" END AS snap
  FROM calendar c CROSS JOIN (SELECT r_name AS state_id FROM region) s""",
}
_NEEDS = {
    "lines": [], "cells": ["lines"], "sales": ["cells"], "dcells": ["lines"],
    "dsales": ["dcells"], "wprices": ["lines"], "dprices": ["dcells", "wprices"], "calendar": [], "externals": ["calendar"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in [*_closure(_NEEDS[name]), name]:
            if n not in out:
                out.append(n)
    return out


def sql(body: str, *ctes: str, recursive: bool = False, **more: str) -> str:
    """``body`` with the named shared CTEs (and what they need) and its own ones in front."""
    parts = [f"{n} AS MATERIALIZED ({_CTES[n]})" for n in _closure(list(ctes))]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


# The twelve levels over a table ``t`` with the keys: one SELECT per level.
_LEVELS = [
    (1, "'Total'", ""), (2, "state_id", "state_id"), (3, "store_id", "store_id"),
    (4, "cat_id", "cat_id"), (5, "dept_id", "dept_id"),
    (6, "state_id || '_' || cat_id", "state_id, cat_id"),
    (7, "state_id || '_' || dept_id", "state_id, dept_id"),
    (8, "store_id || '_' || cat_id", "store_id, cat_id"),
    (9, "store_id || '_' || dept_id", "store_id, dept_id"),
    (10, "item_id", "item_id"), (11, "state_id || '_' || item_id", "state_id, item_id"),
    (12, "id", "id"),
]


def levels_sql(table: str, aggregates: str, period: str | None = "d",
               bottom: str | None = None) -> str:
    """Union of the twelve level aggregates of ``table``."""
    selects = []
    for level, name, cols in _LEVELS:
        agg = bottom if bottom and level == 12 else aggregates
        p = f"{period}, " if period else ""
        groups = ", ".join(x for x in (cols, period or "") if x)
        selects.append(
            f"SELECT {level} AS level_id, {name} AS name, {p}{agg} FROM {table}"
            + (f" GROUP BY {groups}" if groups else "")
        )
    return "\nUNION ALL\n".join(selects)


def strict_sum(c: str) -> str:
    return f"CASE WHEN count(*) = count({c}) THEN sum({c}) END"


def lenient_sum(c: str) -> str:
    return f"coalesce(sum({c}), 0.0)"
