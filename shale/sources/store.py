"""A store of records in hash buckets, merged batch by batch: a batch rewrites the buckets that it touches, and no others.

    <store>/data/<version>-<unique>/_bucket=<n>/part-…    the rows of one bucket, as one merge left them
    <store>/versions/v=<version>/                          the manifest: which folder holds each bucket, and how many rows

A merge writes its buckets' new folders first and its manifest last; readers take the newest manifest that is whole, so they see
a version or the one before it, never a mixture. Each manifest names the batch that made it: a batch that runs again after a
failure finds itself done, or starts anew beside what it left behind. Folders that the last manifests don't name are removed.

The number of buckets is fixed when a store begins; take it so that a bucket of the whole store is a few hundred MB. Rows with a
null key are never merged; they are spread over the buckets by their sequence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shale import storage
from shale.operators.identity import merge_latest

BUCKETS, VERSIONS_KEPT = 64, 2
MANIFEST = "version long, batch string, buckets int, bucket int, path string, rows long"


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def versions(spark: SparkSession, store: str) -> list[int]:
    """The whole versions, ascending."""
    found = [int(n.removeprefix("v=")) for n in _names(spark, f"{store}/versions") if n.startswith("v=")]
    return sorted(v for v in found if "_SUCCESS" in _names(spark, f"{store}/versions/v={v}"))


def _manifest(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{store}/versions/v={version}")


def read(spark: SparkSession, store: str, schema, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the newest version (or of one that is named), of all buckets or some."""
    known = versions(spark, store)
    if not known:
        return spark.createDataFrame([], schema)
    rows = _manifest(spark, store, known[-1] if version is None else version)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    paths = sorted(r.path for r in rows.where("rows > 0").select("path").distinct().collect())  # a row for each bucket
    return spark.read.schema(schema).parquet(*[f"{store}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def bucket_of(key: str, sequence: str, buckets: int) -> Column:
    return F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.col(sequence).cast("long"))), F.lit(buckets)).cast("int")


def merge(batch: DataFrame, store: str, key: str, sequence: str, name: str, buckets: int = BUCKETS, kept: tuple[str, ...] = ("id", "created_at"), stamp: Column | None = None) -> int:
    """Merges batch into the store as :func:`~shale.operators.identity.merge_latest` does; the version that readers now see.

    name: of the batch; one that the newest version is made of isn't merged again. sequence: a column beside the stored ones.
    """
    spark = batch.sparkSession
    schema = batch.drop(sequence).schema
    known = versions(spark, store)
    last = _manifest(spark, store, known[-1]) if known else spark.createDataFrame([], MANIFEST)
    held = storage.kept(last).collect()  # a row for each bucket
    if held and held[0].batch == name:
        return known[-1]
    buckets, version = (held[0].buckets, known[-1] + 1) if held else (buckets, 0)
    batch = storage.kept(batch)
    touched = sorted(r.b for r in batch.select(bucket_of(key, sequence, buckets).alias("b")).distinct().collect())  # of `buckets`, at most
    old = {r.bucket: r for r in held}
    current = read(spark, store, schema, buckets=touched)
    folder = f"data/{version}-{uuid.uuid4().hex}"
    merged = merge_latest(current.withColumn("_null", F.monotonically_increasing_id()), batch.withColumn("_null", F.col(sequence).cast("long")), key, sequence, kept=kept, stamp=stamp)
    # Rows without a key stay where they are found: their bucket is that of this merge, whatever it is.
    spread = F.when(F.col(key).isNotNull(), bucket_of(key, "_null", buckets)).otherwise(F.element_at(F.array(*[F.lit(b) for b in touched or [0]]), F.pmod(F.col("_null"), F.lit(len(touched) or 1)).cast("int") + 1))
    out = merged.withColumn("_bucket", spread).drop("_null")
    out.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{store}/{folder}")
    there = set(_names(spark, f"{store}/{folder}"))
    counts = {r["_bucket"]: r["n"] for r in spark.read.parquet(f"{store}/{folder}").groupBy("_bucket").agg(F.count("*").alias("n")).collect()} if any(n.startswith("_bucket=") for n in there) else {}
    rows = [(version, name, buckets, b, old[b].path, old[b].rows) for b in old if b not in touched]
    rows += [(version, name, buckets, b, f"{folder}/_bucket={b}", counts.get(b, 0)) for b in touched]
    spark.createDataFrame(rows or [(version, name, buckets, -1, "", 0)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{store}/versions/v={version}")
    _remove_old(spark, store)
    return version


def _remove_old(spark: SparkSession, store: str) -> None:
    known = versions(spark, store)
    for v in known[:-VERSIONS_KEPT]:
        storage.delete(spark, f"{store}/versions/v={v}")
    named = {r.path for v in known[-VERSIONS_KEPT:] for r in _manifest(spark, store, v).where("rows > 0").select("path").collect()}
    for folder in _names(spark, f"{store}/data"):
        if not any(path.startswith(f"data/{folder}/") for path in named):
            storage.delete(spark, f"{store}/data/{folder}")
            continue
        for bucket in _names(spark, f"{store}/data/{folder}"):
            if bucket.startswith("_bucket=") and f"data/{folder}/{bucket}" not in named:
                storage.delete(spark, f"{store}/data/{folder}/{bucket}")
