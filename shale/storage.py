"""Results that are computed once, in the folder that all executors share: lost executors don't take them along."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all of Spark runs in this process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if at is None:
        made = context.getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shale-')}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: What is written meanwhile, for :func:`scratch`; each thread has its own.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def _noted(path: str) -> str:
    if (own := _WRITTEN.get()) is not None:
        own.append(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return _noted(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what :func:`kept` and :func:`stored` wrote inside it: for steps whose result is written before the end."""
    own: list[str] = []
    token = _WRITTEN.set(own)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for name in own:
            delete(spark, name)


#: Whether Spark removes the shuffle files of a finished action; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed for the actions inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cleaned(spark: SparkSession):
    """What actions inside it have shuffled is off the disks when they end. A DataFrame's own action must not run twice there.

    That holds for DataFrames that are made inside it: each one keeps to the setting under which it was made.
    """
    return settings(spark, {CLEANUP: "true"})


def _checkpoint(df: DataFrame) -> str | None:
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed."""
    shared_dir(df.sparkSession)
    with cleaned(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    if file := _checkpoint(out):
        _noted(file)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what :func:`kept` wrote for df, when nothing is going to read it any more."""
    if file := _checkpoint(df):
        delete(df.sparkSession, file)


def empty(df: DataFrame) -> bool:
    with cleaned(df.sparkSession):
        return df.isEmpty()


def count(df: DataFrame) -> int:
    with cleaned(df.sparkSession):
        return df.count()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back."""
    path = new_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its place in a total order, from 1.

    A distributed sort gives each row its place within a partition; only the partitions' sizes meet in one place.
    """
    rows = kept(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))  # one row for each partition
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + place + 1).drop("_i", "_p", "_before")
