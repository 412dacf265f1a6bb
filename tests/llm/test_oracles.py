"""The corpus queries with SQL give DuckDB's rows, on the smallest data set."""

import os
from collections import Counter

import duckdb
import pytest

from shale import llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(llm.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = llm.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda r: tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    rows = Counter(plain(r) for r in want.fetchall())
    assert rows and Counter(plain(r) for r in got.select(*columns).collect()) == rows
