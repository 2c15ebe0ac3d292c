"""Every registered query runs on whole tables and equals its SQL twin."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cladeflow.catalog import QUERIES
from cladeflow.oracle import ORACLE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    sql = ORACLE.get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_custom_operators_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"screen_hits", "clusters", "genome_screen"}


def test_entry_registers_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
