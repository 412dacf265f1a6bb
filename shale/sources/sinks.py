"""Writers of the engine's results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.operators.identity import merge_latest
from shale.sources import LISTINGS, TASKS


def identifier(name: str) -> str:
    if not re.fullmatch(r"[0-9A-Za-z_]+", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def ensure_tables(spark: SparkSession, database: str) -> None:
    """Database, listings and crawl_tasks, where they aren't there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {identifier(database)}")
    for name, schema in (("listings", LISTINGS), ("crawl_tasks", TASKS)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def upsert(current: DataFrame, batch: DataFrame, path: str, sequence: str, stamp) -> None:
    """current with batch merged in by content hash, written to a new path: readers switch when it is whole."""
    merge_latest(current, batch, "content_hash", sequence, stamp=stamp).write.parquet(path)


def _statement(spark: SparkSession, url: str, *statements: str) -> None:
    """Runs statements in one transaction of the database, by Spark's own driver for it."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            made = connection.createStatement()
            made.executeUpdate(text)
            made.close()
        connection.commit()
    finally:
        connection.rollback()
        connection.close()


def upsert_sql(name: str, staging: str, columns: list[str], key: str, kept: tuple[str, ...], dialect: str) -> str:
    """The statement that merges the staging table into the table by its key; kept columns of rows that are there stay.

    Spark quotes the names of the columns that it makes, so the staging table's are quoted.
    """
    changed = [c for c in columns if c not in (key, *kept)]
    listed = ", ".join(columns)
    if dialect == "mysql":
        sets = ", ".join(f"{c} = values({c})" for c in changed)
        staged = ", ".join(f"`{c}`" for c in columns)
        return f"insert into {name} ({listed}) select {staged} from {staging} on duplicate key update {sets}"
    sets, values = ", ".join(f'{c} = s."{c}"' for c in changed), ", ".join(f's."{c}"' for c in columns)
    return f'merge into {name} t using {staging} s on t.{key} = s."{key}" when matched then update set {sets} when not matched then insert ({listed}) values ({values})'


def jdbc_upsert(batch: DataFrame, url: str, name: str, key: str, sequence: str, kept: tuple[str, ...] = ("created_at",), dialect: str = "standard", text_type: str = "varchar(8000)", **options: str) -> None:
    """Merges batch into a database table by its unique key: of a key the row with the highest sequence.

    The tasks write a staging table; one statement of the database merges it, so readers see all of the batch or none, and a
    batch that runs again gives the same rows. Rows with a null key are added. text_type: of the staging table's texts; a longer
    one is an error of the database.
    """
    spark = batch.sparkSession
    staging = identifier(f"{name}_stage_{uuid.uuid4().hex[:12]}")
    columns = [identifier(c) for c in batch.columns if c != sequence]
    newest = merge_latest(batch.limit(0).drop(sequence), batch, key, sequence, kept=())
    texts = ", ".join(f"{c} {text_type}" for c, t in newest.select(*columns).dtypes if t == "string")
    newest.select(*columns).write.format("jdbc").options(**options).option("url", url).option("dbtable", staging).option("createTableColumnTypes", texts).mode("overwrite").save()
    try:
        _statement(spark, url, upsert_sql(identifier(name), staging, columns, identifier(key), kept, dialect))
    finally:
        _statement(spark, url, f"drop table {staging}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines added to a log, credentials blanked in all texts."""
    df.select(*[tx.redact(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("append").json(path)


def error_context(method, url, status, reason):
    """A request's context as JSON without blanks, credentials blanked."""
    return F.to_json(F.struct(tx.filled(method).alias("method"), tx.redact(tx.filled(url)).alias("url"), status.alias("status"), tx.redact(tx.filled(reason)).alias("reason")))


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header in each file; the first header cell carries the byte order mark."""
    first = df.columns[0]
    (df.withColumnRenamed(first, f"﻿{first}") if bom else df).write.csv(path, header=True, escape='"')


def markdown(title: str, sections: list[tuple[str, DataFrame, int]]) -> str:
    """A report: of each section at most its own number of rows comes to the driver."""
    out = [f"# {title}"]
    for name, df, most in sections:
        rows = df.limit(most).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file under path, in any store that Spark knows."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def capture(df: DataFrame, path: str) -> None:
    """Captured requests as partitioned rows: metadata, an excerpt and the body's extension, by site."""
    out = df.withColumns({"response_extension": tx.extension(F.col("content_type")), "excerpt": tx.truncated(F.col("body"), 12_000), "sensitive_values_stored": F.lit(False)})
    out.write.partitionBy("slug").mode("append").parquet(path)


def quoted(x):
    """In quotes as a literal: single ones, or double ones round a text with single ones only."""
    plain = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = x.contains("'") & ~x.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def curl(method, url, headers, body):
    """A shell command for the request; headers: array of 'Name: value', of which cookies have their own option."""
    none = F.array().cast("array<string>")
    option = lambda test, text: F.when(test, F.array(text)).otherwise(none)

    def header(h):
        name, value = F.lower(F.trim(F.split_part(h, F.lit(":"), F.lit(1)))), F.regexp_replace(h, r"^[^:]*:\s*", "")
        return F.when(name == "cookie", F.concat(F.lit("-b "), quoted(value))).otherwise(F.concat(F.lit("-H "), quoted(h)))

    verb = F.upper(method)
    parts = F.concat(
        F.array(F.lit("curl -L")), option(verb != "GET", F.concat(F.lit("-X "), verb)), F.array(quoted(url)),
        F.transform(F.coalesce(headers, none), header), option(F.coalesce(body.isNotNull(), F.lit(False)), F.concat(F.lit("--data "), quoted(body))),
    )
    return F.array_join(parts, " \\\n  ")
