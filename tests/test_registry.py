import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = set()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="demonstration tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(rel.fetchall(), rel.columns, order)


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql() and n not in SLOW])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
