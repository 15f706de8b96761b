"""Compare registered queries with their SQL on DuckDB.

Usage: python -m tests.oracle [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (int, str, bool)):
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, tuple) else repr(v)) for v in row)


def mismatch(df, con, sql: str) -> str | None:
    """None when both results hold the same rows, else what differs."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=_key)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{cols}: {a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tallycast.session import local_session

    root = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        root, argv = argv[1], argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(root), oracle_sql(), 0
    for name, fn in queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, root)
            if name in sqls:
                problem = mismatch(df, con, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:400]}"
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
