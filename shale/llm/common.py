"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.storage import cleaned, count, dropped, empty, kept, new_path, shared_dir, stored

__all__ = ["apart_from", "cleaned", "count", "dropped", "empty", "identified", "kept", "new_path", "packed", "shared_dir", "stored", "table", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text): all columns in one struct, so that no name of an operator's own clashes with theirs.

    ``select("_row.*")`` gives them back.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def apart_from(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """(_row, text), and the columns that give back those of docs but text and names: any name can go through Arrow in _row."""
    rest = [c for c in docs.columns if c != "text" and c not in names]
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in rest])
    return docs.select(row.alias("_row"), "text"), [F.col(f"_row.`{c}`").alias(c) for c in rest]


def identified(docs: DataFrame, from_files: bool, name: str) -> DataFrame:
    """packed(docs) with ``_rid`` struct<file, row>, a key of the row that is the same whenever it is computed.

    from_files: docs are rows of Parquet files, each at most once; a row is then known by its file and its place there, and
    nothing is copied. Other rows (and files without places) are written to the shared folder first.
    """
    key = lambda frame: F.struct(F.xxhash64(frame.metadataColumn("_metadata")["file_path"]).alias("file"), frame.metadataColumn("_metadata")["row_index"].alias("row"))
    if from_files:
        try:
            return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", key(docs).alias("_rid"))
        except AnalysisException:
            pass
    found = stored(packed(docs), name)
    return found.select("*", key(found).alias("_rid"))
