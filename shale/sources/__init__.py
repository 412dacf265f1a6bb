"""Readers of the engine's inputs."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(columns: str) -> T.StructType:
    """Of 'name type, ...'; works without a session, unlike DDL strings."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: The listing record as stored.
LISTINGS = _schema(
    "id long, content_hash string, origin string, source_site string, crawl_url string, detail_url string, pid string, category_code string, category_name string, "
    "listing_name string, model_name string, model_norm string, description string, price string, price_krw long, contact string, posted_date date, "
    "posted_at timestamp_ntz, crawled_at timestamp_ntz, manufacturer string, manufactured_ym string, location string, seller string, status string, "
    "view_count int, raw_json string, payload_json string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
TASKS = _schema(
    "id long, site_slug string, origin string, task_type string, url_hash string, url string, category_code string, category_name string, page int, priority int, "
    "status string, attempts int, last_status_code int, last_error string, next_run_at timestamp, success_at timestamp, metadata_json string, created_at timestamp, updated_at timestamp"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text, a byte order mark removed."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def csv_typed(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV with types: by the schema, else inferred."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"') if schema else spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document for each file, with its file's name as slug."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("slug", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1))


def captured_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content): bodies of captured pages."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def dictionary_line(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the values of a dictionary file of one line."""
    line = spark.read.text(path, wholetext=True).select(F.split_part(F.regexp_replace("value", "^﻿", ""), F.lit("\n"), F.lit(1)).alias("line"))
    return line.select(F.posexplode(F.split("line", ",")).alias("pos", "value")).select("pos", F.trim("value").alias("value")).where("value <> ''")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(rows, schema)


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Stored listings; missing columns are null."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LISTINGS])


def jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int = 64, **options: str) -> DataFrame:
    """A database table, read in parts by ranges of a numeric key; the database is asked for the key's least and greatest first.

    Filters and column lists that follow are pushed to the database. An empty table is read in one part.
    """
    asked = spark.read.format("jdbc").options(**options).option("url", url)
    low, high = asked.option("query", f"select min({key}) as low, max({key}) as high from {name}").load().first()  # one row
    table = spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", name)
    if low is not None:
        table = table.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high + 1)).option("numPartitions", str(parts))
    return table.load()


def tasks_or_empty(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or no rows of its schema where there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], TASKS)


@dataclass(frozen=True)
class Config:
    """Options of a run; from_conf reads them from the session (shale.<name>)."""

    mode: str = "all"
    sleep: float = 0.3
    max_pages: int = 0
    max_categories: int = 0
    max_items: int = 0
    batch: int = 20

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Config:
        given = {f.name: spark.conf.get(f"shale.{f.name}", None) for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name] is not None})


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that are there, in any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p if "://" in p else f"file://{os.path.abspath(p)}")
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


#: Registered sites: (slug, host). Fixed values.
REGISTRY = (("green_heavy", "4396200.com"),)


def site_slug(wanted: Column, registry=REGISTRY) -> Column:
    """The registered site that a slug, host or origin names; null if none."""
    host = F.regexp_replace(F.lower(wanted), r"^(?:https?://)?(?:www\.)?|/+$", "")
    return F.coalesce(*[F.when((wanted == slug) | (host == name), F.lit(slug)) for slug, name in registry])


def resolve_sites(wanted: list[str] | None = None, registry=REGISTRY) -> list[str]:
    """The wanted sites by slug, host or origin, sorted, each once; all registered ones if none is wanted."""
    by = {host: slug for slug, host in registry} | {slug: slug for slug, _ in registry}
    found = set()
    for name in wanted or by.values():
        slug = by.get(name) or by.get(re.sub(r"^(?:https?://)?(?:www\.)?|/+$", "", name.lower()))
        if slug is None:
            raise ValueError(f"unknown site: {name}")
        found.add(slug)
    return sorted(found)
