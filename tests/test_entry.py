"""The driver's contract: every graph query against its SQL on the smallest tables."""

import datetime as dt
import os
from decimal import Decimal

import duckdb
import pytest

from hopline.catalog import ORACLE, QUERIES

DATA = os.environ.get("HOPLINE_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((str([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted_rows(df.columns, df.collect())
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        assert got == sorted_rows([c[0] for c in found.description], found.fetchall())


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["c_custkey", "r_name", "o_orderkey", "o_totalprice"]


def test_plans_push_filters_and_prune_columns(spark, capsys):
    df = QUERIES["scan_filter"](spark, DATA)
    df.explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThan(c_acctbal,9000.0)" in text and "c_mktsegment" not in text
    QUERIES["theta_cross"](spark, DATA).explain()
    assert "Cartesian" not in capsys.readouterr().out
