"""Record identity: content hash, first-wins distinct and latest-wins merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of the content hash, in order. Fixed values.
HASHED = ("contact", "detail_url", "listing_name", "model_name", "origin", "posted_at", "posted_date", "price")


def content_hash(columns: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the compact JSON of the hashed fields; null counts as ''."""
    columns = columns or {}
    fields = [F.coalesce(columns.get(c, F.col(c)).cast("string"), F.lit("")).alias(c) for c in HASHED]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_latest(current: DataFrame, batch: DataFrame, key: str, sequence: str, kept: tuple[str, ...] = ("id", "created_at"), stamp: Column | None = None) -> DataFrame:
    """current with batch merged in: of a key the row with the highest sequence wins; its first row gives the kept columns.

    Rows with a null key are never merged. Partial aggregation keeps hot keys cheap: a key's rows meet as one row for
    each task. Columns other than kept come from the last row; updated_at is the stamp where the batch touched a key.
    """
    columns = current.columns
    old = current.select(*columns, F.lit(-1).cast("long").alias("_seq"))
    new = batch.withColumn("_seq", F.col(sequence).cast("long"))
    new = new.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in columns], "_seq")
    both = old.unionByName(new)
    rows = F.struct(*columns)
    folded = both.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(rows, "_seq").alias("_last"), F.min_by(rows, "_seq").alias("_first"), F.max("_seq").alias("_seq"))
    touched = F.col("_seq") >= 0

    def column(c: str) -> Column:
        if c in kept:
            return F.col(f"_first.{c}")
        if c == "updated_at" and stamp is not None:
            return F.when(touched, stamp).otherwise(F.col(f"_last.{c}"))
        return F.col(f"_last.{c}")

    return folded.select(*[column(c).alias(c) for c in columns]).unionByName(both.where(F.col(key).isNull()).select(*columns))
