"""Model dictionary: exact match, else the longest entry inside the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shale.functions.text import filled, model_key

#: Shorter keys match only exactly.
LEAST = 4
#: A dictionary of up to so many entries is broadcast.
BROADCAST_ENTRIES = 200_000


def from_values(values: DataFrame, value: str = "value", position: str = "pos") -> DataFrame:
    """(key, canonical, ord) of a column of names: of equal keys the last name counts, at the first one's place."""
    keyed = values.select(model_key(F.col(value)).alias("key"), F.col(value).alias("canonical"), F.col(position).alias("ord")).where(F.col("key") != "")
    return keyed.groupBy("key").agg(F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))


def _sized(entries: DataFrame) -> DataFrame:
    return F.broadcast(entries) if entries.count() <= BROADCAST_ENTRIES else entries


def _substrings(key: Column, n: int) -> Column:
    """All parts of n characters, of keys longer than that."""
    places = F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1)))
    return F.when(F.length(key) > n, F.transform(places, lambda i: F.substr(key, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def match(texts: DataFrame, text: str, entries: DataFrame, out: str = "model_norm") -> DataFrame:
    """texts with the matched canonical name (null: none).

    Each distinct key is matched once. Its substrings of the entries' lengths meet the entries in a hash join, so the
    work grows with the texts, not with texts times entries. Of the longest entries the first in the dictionary wins.
    """
    entries = _sized(entries)
    sizes = [r[0] for r in entries.where(F.length("key") >= LEAST).select(F.length("key").alias("n")).distinct().orderBy("n").collect()]
    keys = texts.select(model_key(F.col(text)).alias("_key")).where(F.coalesce(F.col("_key"), F.lit("")) != "").distinct()
    exact = keys.join(entries.select(F.col("key").alias("_key"), "canonical"), "_key")
    left = keys.join(exact.select("_key"), "_key", "left_anti")
    parts = [_substrings(F.col("_key"), n) for n in sizes]
    if parts:
        inside = left.select("_key", F.explode(F.array_distinct(F.concat(*parts))).alias("key")).join(entries, "key")
        longest = inside.groupBy("_key").agg(F.max_by("canonical", F.struct(F.length("key"), -F.col("ord"))).alias("canonical"))
        exact = exact.unionByName(longest)
    found = exact.select("_key", F.col("canonical").alias(out))
    return texts.withColumn("_key", model_key(F.col(text))).join(found, "_key", "left").drop("_key")


def match_first(texts: DataFrame, columns: list[str], entries: DataFrame, out: str = "model_norm") -> DataFrame:
    """The first column with a match counts."""
    step = texts
    for i, c in enumerate(columns):
        step = match(step, c, entries, f"_m{i}")
    names = [f"_m{i}" for i in range(len(columns))]
    return step.withColumn(out, F.coalesce(*[F.col(n) for n in names])).drop(*names)


def value_or(column: str, default: Column) -> Column:
    return F.coalesce(filled(F.col(column)), default)
