"""Owners: listings rolled up by phone number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.operators.listings import clamp, normalized

SELLERS, SITES = 3, 4


def source_rows(listings: DataFrame) -> DataFrame:
    """All listings with a contact: a seller's count and first names follow every one of them."""
    return listings.where(F.trim("contact") != "")


def by_phone(listings: DataFrame) -> DataFrame:
    """(phone, row): one row for each distinct number of a listing."""
    return normalized(listings).withColumn("phone", F.explode(tx.phones(F.col("contact"))))


def _first(rows: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """(phone, name): the first n distinct filled values in posting order; only these are gathered."""
    seen = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("phone", F.col(column).alias("_v")).agg(F.min("_o").alias("_o"))
    first = seen.withColumn("_n", F.row_number().over(Window.partitionBy("phone").orderBy("_o"))).where(F.col("_n") <= n)
    return first.groupBy("phone").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]), ", ").alias(name))


def roll_up(listings: DataFrame, q: str = "", limit=None) -> DataFrame:
    """One row for each phone: listings, first sellers and sites, latest times.

    The search looks into the phone and the lists as they are shown.
    """
    rows = by_phone(listings)
    newest = F.struct(F.coalesce(-F.unix_micros(F.col("posted_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("t"), (-F.col("id")).alias("i"))
    rows = rows.withColumn("_o", newest)
    counts = rows.groupBy("phone").agg(F.countDistinct("id").alias("listing_count"), F.max(F.coalesce(F.col("posted_at").cast("string"), F.col("posted_date").cast("string"))).alias("latest_posted"), F.max("crawled_at").alias("latest_crawled"))
    out = counts.join(_first(rows, "seller", SELLERS, "sellers"), "phone", "left").join(_first(rows, "site_short", SITES, "sites"), "phone", "left")
    out = out.fillna("", ["sellers", "sites"]).withColumn("phone_display", tx.format_phone(F.col("phone")))
    if q.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "phone", "phone_display", "sellers", "sites")), F.lower(F.lit(q.strip()))))
    return out.orderBy(F.desc("listing_count"), F.desc_nulls_last("latest_posted"), "phone").limit(clamp(limit))


def listings_of(listings: DataFrame, phone: str) -> DataFrame:
    """Listings whose contact holds the number, each id once."""
    wanted = tx.normalize_phone(F.lit(phone))
    return normalized(listings.where(F.array_contains(tx.phones(F.col("contact")), wanted)).dropDuplicates(["id"]))


def counts(listings: DataFrame) -> DataFrame:
    """Listings with a number, and the owners among them; before any search."""
    n = F.size(tx.phones(F.col("contact")))
    return listings.agg(F.count_if(n > 0).alias("listing_with_phone_count")).join(F.broadcast(by_phone(listings).agg(F.countDistinct("phone").alias("owner_count"))))
