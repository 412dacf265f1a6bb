"""Listing search: filters, order presets, the pre-limit, ranges on derived values, and statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.functions import urls

#: Columns that a search looks into. Fixed values.
SEARCHED = ("listing_name", "model_name", "model_norm", "description", "price", "contact", "manufacturer", "location", "seller", "category_name", "source_site", "origin")
PRE_LIMIT, DEFAULT_LIMIT, MOST = 50_000, 1_000, 5_000
TASK_DEFAULT, TASK_MOST = 500, 2_000


def clamp(value, default: int = DEFAULT_LIMIT, most: int = MOST) -> int:
    """A limit of 1 to most; None or '' gives the default, other texts without a number an empty result."""
    if value in (None, ""):
        return default
    try:
        return min(max(int(float(value)), 1), most)
    except ValueError:
        return 0


def clamped(value: Column, default: int = DEFAULT_LIMIT, most: int = MOST) -> Column:
    """:func:`clamp` of a column of texts."""
    number = F.floor(value.try_cast("double")).cast("int")
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(F.least(F.greatest(number, F.lit(1)), F.lit(most)), F.lit(0)))


def active_filters(*values: Column) -> Column:
    """How many of the filters' values are filled."""
    return reduce(Column.__add__, [F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.lit(1)).otherwise(F.lit(0)) for v in values])


@dataclass(frozen=True)
class Search:
    """Parameters of a search; what doesn't parse is ignored."""

    q: str = ""
    date_from: str = ""
    date_to: str = ""
    price_from: str = ""
    price_to: str = ""
    made_from: str = ""
    made_to: str = ""
    hours_from: str = ""
    hours_to: str = ""
    sort: str = "posted_desc"
    limit: object = None

    def active(self) -> int:
        return sum(bool(str(x).strip()) for x in (self.q, self.date_from, self.date_to, self.price_from, self.price_to, self.made_from, self.made_to, self.hours_from, self.hours_to))


def number_param(value: str) -> int | None:
    t = str(value or "").replace(",", "").strip()
    return int(float(t)) if re.fullmatch(r"[+-]?\d+(\.\d+)?", t) else None


def both(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def search_filter(p: Search, columns: list[str]) -> Column:
    """Text, date and price filters. The text keeps % and _ as wildcards and ignores case."""
    tests = []
    if q := p.q.strip():
        tests.append(reduce(Column.__or__, [F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(f"%{q}%") for c in SEARCHED if c in columns]))
    day = lambda v: re.fullmatch(r"\d{4}-\d{2}-\d{2}", v or "")
    if day(p.date_from):
        tests.append(F.col("posted_date") >= F.lit(p.date_from).cast("date"))
    if day(p.date_to):
        tests.append(F.col("posted_date") <= F.lit(p.date_to).cast("date"))
    if (n := number_param(p.price_from)) is not None:
        tests.append(F.col("price_krw") >= n)
    if (n := number_param(p.price_to)) is not None:
        tests.append(F.col("price_krw") <= n)
    return both(tests)


def store_order(sort: str) -> list[Column]:
    """Order of the stored rows."""
    c = F.col
    return {
        "posted_asc": [c("posted_at").asc_nulls_last(), c("posted_date").asc_nulls_first(), c("crawled_at").desc_nulls_last(), c("id").desc()],
        "price_desc": [c("price_krw").desc_nulls_last(), c("posted_at").desc_nulls_last(), c("id").desc()],
        "price_asc": [c("price_krw").asc_nulls_last(), c("posted_at").desc_nulls_last(), c("id").desc()],
    }.get(sort, [c("posted_at").desc_nulls_last(), c("posted_date").desc_nulls_last(), c("crawled_at").desc_nulls_last(), c("id").desc()])


def final_order(sort: str) -> list[Column]:
    """Order of the answer: one key of its own, then the store's order. Zero prices tie with missing ones when descending."""
    posted = F.coalesce(F.col("posted_at").cast("timestamp_ntz"), F.col("posted_date").cast("timestamp_ntz"))
    own = {
        "price_desc": F.when(F.col("price_krw") == 0, F.lit(None)).otherwise(F.col("price_krw")).desc_nulls_last(),
        "price_asc": F.col("price_krw").asc_nulls_last(),
        "posted_asc": posted.asc_nulls_first(),
    }.get(sort, posted.desc_nulls_last())
    return [own, *store_order(sort)]


def normalized(rows: DataFrame) -> DataFrame:
    """Stored rows with display columns; '' counts as missing."""
    source = tx.first_filled(F.col("source_site"), F.col("origin"))
    link = F.coalesce(tx.first_filled(F.col("detail_url"), F.col("crawl_url")), F.lit(""))
    return rows.withColumns(
        {
            "display_name": tx.first_filled(F.col("listing_name"), F.lit("-")),
            "model": F.coalesce(tx.first_filled(F.col("model_norm"), F.col("model_name")), F.lit("")),
            "site": F.coalesce(source, F.lit("-")),
            "site_short": site_short(source, F.coalesce(tx.first_filled(F.col("origin"), F.col("detail_url"), F.col("crawl_url")), F.lit(""))),
            "link": link,
            "posted_day": F.coalesce(F.col("posted_date"), F.col("posted_at").cast("date")),
            "made_ym": tx.year_month(F.col("manufactured_ym")),
            "operating_hours": tx.operating_hours(F.col("raw_json"), F.col("description"), F.col("listing_name"), F.col("model_name")),
        }
    )


#: (part of the source, short name). Fixed values.
SITES = (("그린", "그린"), ("Mascus", "Mascus"), ("중기114", "중기114"))
TASK_SITES = (("green_heavy", "그린중기"), ("mascus_korea", "Mascus"), ("junggi114", "중기114"))


def site_short(source: Column, url: Column) -> Column:
    """A known name, the first label of the host, else the source's first 12 characters."""
    host = F.regexp_replace(F.regexp_replace(urls.part(url, 2), r":\d*$", ""), r"^www\.", "")
    out = F.when(F.lit(False), F.lit(""))
    for mark, name in SITES:
        out = out.when(source.contains(mark), F.lit(name))
    return out.when(host != "", F.split_part(F.lower(host), F.lit("."), F.lit(1))).otherwise(F.substr(F.coalesce(source, F.lit("-")), F.lit(1), F.lit(12)))


def range_filter(p: Search) -> Column:
    """Ranges over manufacture month and operating hours; missing values fail an active range."""
    tests = []
    for value, test in ((p.made_from, "ge"), (p.made_to, "le")):
        if (n := tx.year_month_param(value)) is not None:
            tests.append(F.col("made_ym") >= n if test == "ge" else F.col("made_ym") <= n)
    for value, test in ((p.hours_from, "ge"), (p.hours_to, "le")):
        if (n := number_param(value)) is not None:
            tests.append(F.col("operating_hours") >= n if test == "ge" else F.col("operating_hours") <= n)
    return both(tests)


def search(listings: DataFrame, p: Search, before: int = PRE_LIMIT) -> DataFrame:
    """The answer rows in order, with their rank.

    Ranges on derived values apply after the store's limit, as the interface promises; both limits are top-k plans.
    """
    head = listings.where(search_filter(p, listings.columns)).orderBy(*store_order(p.sort)).limit(before)
    return normalized(head).where(range_filter(p)).orderBy(*final_order(p.sort)).limit(clamp(p.limit))


def stats(listings: DataFrame) -> DataFrame:
    """Over all rows, whatever the search."""
    return listings.agg(F.count("*").alias("total"), F.count("price_krw").alias("priced"), F.max("posted_date").alias("latest"))


def capped(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows in that order; all rows if most is 0."""
    return rows.orderBy(*order).limit(most) if most else rows


def display_stats(stats: DataFrame) -> DataFrame:
    """:func:`stats` as texts: numbers with thousands separators, 0 and '-' where there is nothing."""
    number = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0).alias(c)
    return stats.select(number("total"), number("priced"), F.coalesce(F.col("latest").cast("string"), F.lit("-")).alias("latest"))


def enriched(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records with model_norm (from model_name, then listing_name) and price_krw where these are missing."""
    from shale.operators.dictionary import match_first

    has = lambda c: F.col(c) if c in records.columns else F.lit(None)
    out = match_first(records, ["model_name", "listing_name"], entries, "_found")
    return out.withColumn("model_norm", F.coalesce(has("model_norm"), F.col("_found"))).withColumn("price_krw", F.coalesce(has("price_krw").cast("long"), tx.price_krw(F.col("price")))).drop("_found")


#: Detail values that replace those of the list row.
OVERLAID = ("model_name", "price", "contact", "manufacturer", "location", "status", "manufactured_ym", "description")


def overlaid(listed: DataFrame, details: DataFrame, key: str = "pid") -> DataFrame:
    """List rows with their details laid over: filled values win, and the title is rebuilt with the manufacturer."""
    extra = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in (*OVERLAID, "detail_title", "posted_at", "posted_date") if c in details.columns])
    out = listed.join(extra, key, "left")
    for c in OVERLAID:
        if f"_d_{c}" in out.columns:
            out = out.withColumn(c, F.coalesce(tx.filled(F.col(f"_d_{c}")), F.col(c) if c in out.columns else F.lit(None)))
    if "_d_detail_title" in out.columns:
        out = out.withColumn("listing_name", F.when(tx.filled(F.col("_d_detail_title")).isNotNull(), tx.clean_text(F.concat_ws(" ", "manufacturer", "_d_detail_title"))).otherwise(F.col("listing_name")))
    for c in ("posted_at", "posted_date"):
        if f"_d_{c}" in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"_d_{c}"), F.col(c)))
    return out.drop(*[c for c in out.columns if c.startswith("_d_")])


def detail_step(listed: DataFrame, details: DataFrame, mode: str, now: Column, key: str = "pid") -> DataFrame:
    """The records of detail tasks: list rows (with metadata_json) with their details laid over, hashed, and of the period.

    A task whose metadata has no object ``record`` gives no record; neither does one without a detail page.
    """
    from shale.operators.identity import content_hash

    record = F.try_variant_get(F.try_parse_json("metadata_json"), "$.record", "map<string,variant>")
    whole = listed.where(record.isNotNull()).join(details.select(key).distinct(), key, "left_semi")
    out = overlaid(whole, details, key).withColumn("content_hash", content_hash())
    return out.where(tx.in_period(F.coalesce(F.col("posted_at"), F.col("posted_date").cast("timestamp_ntz")), mode, now))


#: Columns that are stored as they are; the others of a record go into its payload.
STORED = ("content_hash", "origin", "source_site", "crawl_url", "detail_url", "pid", "listing_name", "model_name", "model_norm", "price", "price_krw", "contact", "status")


def stored_row(records: DataFrame) -> DataFrame:
    """Records as they are stored: the date from posted_date, else posted_at; times without zone; counts from text; JSON."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return records.select(
        *[has(c).alias(c) for c in STORED],
        F.coalesce(has("posted_date").cast("string").try_cast("date"), has("posted_at").cast("string").try_cast("timestamp_ntz").cast("date")).alias("posted_date"),
        *[has(c).cast("string").try_cast("timestamp_ntz").alias(c) for c in ("posted_at", "crawled_at")],
        tx.nullable_int(has("view_count").cast("string")).cast("int").alias("view_count"),
        (F.to_json("raw") if "raw" in records.columns else F.lit(None).cast("string")).alias("raw_json"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("payload_json"),
    )
