"""Database tables, with the embedded database that Spark ships."""

import pytest
from pyspark.sql import functions as F

from shale import sources
from shale.sources import sinks

SCHEMA = "id int, name string, price int, created_at int, seq int"


@pytest.fixture(scope="module")
def url(spark):
    at = "jdbc:derby:memory:shale;create=true"
    sinks._statement(spark, at, "create table listings (id int, name varchar(100), price int, created_at int)")
    return at


def rows(spark, url):
    return sorted((tuple(r) for r in sources.jdbc(spark, url, "listings", "id", 4).select("ID", "NAME", "PRICE", "CREATED_AT").collect()), key=str)


def test_upsert_and_partitioned_scan(spark, url):
    assert rows(spark, url) == []
    one = spark.createDataFrame([(i, f"n{i}", i * 10, 1, i) for i in range(100)] + [(5, "newer", 55, 2, 900)], SCHEMA).repartition(3)
    sinks.jdbc_upsert(one, url, "listings", "id", "seq")
    want = {i: (i, f"n{i}", i * 10, 1) for i in range(100)} | {5: (5, "newer", 55, 2)}
    assert rows(spark, url) == sorted(want.values(), key=str)
    two = spark.createDataFrame([(7, "seven", 77, 9, 1), (200, "new", 1, 9, 2), (None, "no key", 3, 9, 3)], SCHEMA)
    sinks.jdbc_upsert(two, url, "listings", "id", "seq")
    want |= {7: (7, "seven", 77, 1), 200: (200, "new", 1, 9)}  # what a row was created at stays
    found = rows(spark, url)
    assert [r for r in found if r[0] is not None] == sorted(want.values(), key=str) and [r for r in found if r[0] is None] == [(None, "no key", 3, 9)]
    table = sources.jdbc(spark, url, "listings", "id", 4)
    assert table.rdd.getNumPartitions() == 4
    plan = table.where((F.col("PRICE") > 500) & (F.col("NAME") == "n60")).select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(PRICE)" in plan.replace("*IsNotNull(NAME), ", "") or "*GreaterThan(PRICE,500)" in plan
    assert "*EqualTo(NAME,n60)" in plan and "ReadSchema: struct<ID:int>" in plan
    assert [r.ID for r in table.where("PRICE > 500 and NAME = 'n60'").collect()] == [60]


def test_statements():
    assert sinks.upsert_sql("t", "s", ["k", "a", "created_at"], "k", ("created_at",), "mysql") == "insert into t (k, a, created_at) select `k`, `a`, `created_at` from s on duplicate key update a = values(a)"
    with pytest.raises(ValueError):
        sinks.identifier("t; drop")
