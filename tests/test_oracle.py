"""Every registered query with SQL gives the same rows on both engines."""

import os
import subprocess
import sys
from functools import cache

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallycast.sources import orderbook as ob
from tests.oracle import connect, mismatch

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def shared_views():
    """Both demand views are staged once for all queries of this module."""
    plain = {name: getattr(ob, name) for name in ("monthly_view", "daily_view")}

    def sharing(name):
        made = cache(lambda spark, root: plain[name](spark, root, staged=True))
        return lambda spark, root, staged=False: made(spark, root)

    for name in plain:
        setattr(ob, name, sharing(name))
    yield
    for name, function in plain.items():
        setattr(ob, name, function)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, shared_views, name):
    assert mismatch(queries()[name](spark, sf_dir), con, SQL[name]) is None


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(queries())


def test_entry_without_a_library_of_the_text_operators():
    """The other queries are registered even if the text operators cannot be imported."""
    code = ("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; "
            "names = e.queries(); assert len(names) > 140 and 'pipeline' not in names; "
            "assert set(e.oracle_sql()) <= set(names); print(len(names))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["level_id", "name", "scale", "mse", "rmsse", "weight", "wrmsse"]
    assert df.count() > 0
