"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, plain  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
# one query of each family; tools/check.py runs all of them
NAMES = ["q05", "q07", "q08", "q15", "q17", "q22", "q31", "q34", "q37", "q40", "q41", "q45", "q52", "q58", "q61", "q63", "q88", "q89", "q90", "q91", "q92", "q93"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("prefix", NAMES)
def test_query_equals_sql(spark, db, prefix):
    name = next(n for n in entry.queries() if n.startswith(prefix))
    df = entry.queries()[name](spark, FOLDER)
    db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in db.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in db.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 25
