"""The text and corpus queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from hopline.llm.oracle import ORACLE
from hopline.llm.queries import QUERIES

DATA = os.environ.get("HOPLINE_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, (tuple(r) for r in found))) and rows
