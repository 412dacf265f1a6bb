"""Every query with an oracle gives DuckDB's rows, on the smallest data set."""

import math
import os
from collections import Counter

import duckdb
import pytest

from shale.plans import registry

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries over the given pages, whose rarer forms the smallest data set doesn't hold.
HTML = ("bodies", "contract_given", "html_links", "html_titles", "page_analysis_given", "page_analysis_plain", "page_kind", "page_links_given")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _views(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return _views(DATA)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(spark, con, data, name):
    got = registry.QUERIES[name](spark, data)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine = Counter(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    assert mine == Counter(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same(spark, duck, DATA, name)


@pytest.mark.parametrize("name", HTML)
def test_oracle_of_more_pages(spark, name):
    same(spark, _views(MORE), MORE, name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
