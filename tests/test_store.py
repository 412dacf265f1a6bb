"""The store of buckets."""

from pathlib import Path

from pyspark.sql import functions as F

from shale.operators import identity
from shale.sources import store

SCHEMA = "id long, content_hash string, price string, created_at int, updated_at int, seq long"


def files(at):
    return {(p.name, int(p.parent.name.removeprefix("_bucket="))) for p in Path(at, "data").glob("*/*/part-*")}


def shown(df):
    return sorted(map(str, (tuple(r) for r in df.select("id", "content_hash", "price", "created_at", "updated_at").collect())))


def test_merges_equal_the_whole_merge(spark, tmp_path):
    at = f"{tmp_path}/store"
    row = lambda i, h, p: (i, h, p, i, i, i)
    one = spark.createDataFrame([row(i, f"h{i % 40}", f"p{i}") for i in range(100)] + [row(100 + i, None, "n") for i in range(7)], SCHEMA)
    two = spark.createDataFrame([row(200 + i, f"h{i}", f"q{i}") for i in range(3)] + [row(300, "new", "x"), row(301, None, "n2")], SCHEMA)
    plain = one.drop("seq").schema
    assert store.merge(one, at, "content_hash", "seq", "a", buckets=16) == 0
    whole = identity.merge_latest(spark.createDataFrame([], plain), one, "content_hash", "seq")
    assert shown(store.read(spark, at, plain)) == shown(whole)
    before = files(at)
    assert store.merge(two, at, "content_hash", "seq", "b", stamp=F.lit(99)) == 1
    now = shown(store.read(spark, at, plain))
    assert now == shown(identity.merge_latest(whole, two, "content_hash", "seq", stamp=F.lit(99)))
    touched = {r.b for r in two.select(store.bucket_of("content_hash", "seq", 16).alias("b")).distinct().collect()}
    same = {(n, b) for n, b in before if b not in touched}
    assert same and same <= files(at) and len(touched) < 6
    assert store.merge(two, at, "content_hash", "seq", "b") == 1 and shown(store.read(spark, at, plain)) == now  # the batch ran again
    assert shown(store.read(spark, at, plain, version=0)) == shown(whole)  # a reader that has begun goes on
    third = spark.createDataFrame([row(400, f"h{i}", "z") for i in range(40)], SCHEMA)
    for name in ("c", "d"):
        store.merge(third, at, "content_hash", "seq", name)
    gone = {r.b for r in third.select(store.bucket_of("content_hash", "seq", 16).alias("b")).distinct().collect()}
    assert store.versions(spark, at) == [2, 3] and len(gone) > 8 and not {b for _, b in before & files(at)} & gone  # old folders are gone
    assert store.merge(third.limit(0), at, "content_hash", "seq", "e") == 4 and len(shown(store.read(spark, at, plain))) == 40 + 1 + 8


def test_a_broken_merge_leaves_the_last_version(spark, tmp_path):
    at = f"{tmp_path}/store"
    one = spark.createDataFrame([(1, "h", "p", 1, 1, 1)], SCHEMA)
    store.merge(one, at, "content_hash", "seq", "a")
    Path(at, "versions", "v=1").mkdir()  # a manifest without its mark
    Path(at, "data", "1-broken", "_bucket=0").mkdir(parents=True)
    assert store.versions(spark, at) == [0] and store.read(spark, at, one.drop("seq").schema).count() == 1
    assert store.merge(one.withColumn("price", F.lit("q")), at, "content_hash", "seq", "b") == 1
    assert [r.price for r in store.read(spark, at, one.drop("seq").schema).collect()] == ["q"]
    assert not Path(at, "data", "1-broken").exists()


def test_empty_store(spark, tmp_path):
    assert store.read(spark, f"{tmp_path}/none", SCHEMA).count() == 0 and store.versions(spark, f"{tmp_path}/none") == []
