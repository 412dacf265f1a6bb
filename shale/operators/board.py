"""List and detail pages of a table-based board as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.functions import urls
from shale.operators import html as h

#: Marks of rows that are no listings, and the house's own seller name. Fixed values.
PINNED, HOUSE = ("btn16.png", "vip", "btn17.png", "cool"), "그린중기"
HEADERS, CELLS = ("모델명", "등록날짜"), 12
#: Cell number by field; label by detail field. Fixed values.
FIELDS = {"trade_type": 2, "manufacturer": 3, "model_name": 4, "manufactured_ym": 5, "status": 6, "location": 7, "price": 8, "seller": 9, "posted": 10, "view_count": 11}
LABELS = {"model_name": "모델명", "price": "가격", "contact": "연락처", "manufacturer": "제작사", "location": "위치", "status": "상태", "manufactured_ym": "제작년월"}


def listing_rows(pages: DataFrame, now: Column, key: str = "page_id") -> DataFrame:
    """The listings of parsed list pages: rows of the first table with both headers, without pinned ones."""
    heads = F.filter("page.rows", lambda r: F.array_contains(r["head"], HEADERS[0]) & F.array_contains(r["head"], HEADERS[1]))
    first = F.array_min(F.transform(heads, lambda r: r["table_no"]))
    rows = pages.withColumn("_first", first).select(key, "url", "_first", F.posexplode("page.rows").alias("pos", "r")).where(F.col("r.table_no") == F.col("_first"))
    rows = rows.withColumn("cells", F.expr("transform(filter(arrays_zip(r.cells, r.kinds), x -> x.kinds = 'td'), x -> x.cells)"))
    cell = lambda i: tx.stripped(F.get("cells", F.lit(i)))
    pinned = F.lit(False)
    for mark in PINNED:
        pinned = pinned | F.col("r.first_marks").contains(mark)
    rows = rows.where((F.size("cells") >= CELLS) & ~pinned & (cell(9) != HOUSE) & F.col("r.href").isNotNull())
    site_url = urls.absolute(F.col("url"), F.col("r.href"))
    rows = rows.select(key, "pos", F.col("url").alias("crawl_url"), site_url.alias("site_detail_url"), *[cell(i).alias(name) for name, i in FIELDS.items()], F.col("cells").alias("list_values"))
    rows = rows.withColumn("pid", F.nullif(F.regexp_extract("site_detail_url", r"[?&]pid=(\d+)", 1), F.lit("")))
    rows = rows.withColumn("detail_url", F.when(F.col("pid").isNotNull(), F.concat(urls.base_endpoint(F.col("site_detail_url")), F.lit("?pid="), F.col("pid"))).otherwise(F.col("site_detail_url")))
    rows = rows.withColumn("posted_at", tx.site_date(F.col("posted"), now))
    rows = rows.withColumns({"posted_date": F.col("posted_at").cast("date"), "listing_name": tx.clean_text(F.concat_ws(" ", "manufacturer", "model_name"))})
    return rows.withColumn("raw", F.struct("trade_type", "list_values", "site_detail_url")).drop("trade_type", "list_values", "site_detail_url", "posted")


def details(pages: DataFrame, now: Column, key: str = "page_id") -> DataFrame:
    """The fields of parsed detail pages."""
    kv = h.key_values(F.col("page"))
    dates = F.filter(F.transform("page.right_cells", lambda x: tx.site_date(x, now)), lambda x: x.isNotNull())
    rows = pages.withColumns({"raw_detail": kv, "posted_at": F.get(dates, F.lit(0))})
    return rows.select(key, "url", F.nullif(tx.clean_text(F.col("page.product_title")), F.lit("")).alias("detail_title"), "posted_at", F.col("posted_at").cast("date").alias("posted_date"), *[F.try_element_at("raw_detail", F.lit(label)).alias(name) for name, label in LABELS.items()], F.nullif(tx.clean_text(F.col("page.comment")), F.lit("")).alias("description"), "raw_detail")


def categories(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, code, name): six-digit category codes of the links, the first name of each."""
    links = pages.select(key, F.posexplode("page.links").alias("pos", "a")).where(F.col("a.href").contains("sub8_1_s.html?cate_code="))
    found = links.select(key, "pos", F.regexp_extract("a.href", r"[?&]cate_code=([^&#]*)", 1).alias("code"), tx.clean_text(F.col("a.label")).alias("label")).where(F.col("code").rlike(r"^\d{6}$"))
    named = found.withColumn("name", F.coalesce(F.nullif("label", F.lit("")), "code"))
    return named.groupBy(key, "code").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))


def expected_next(pages: DataFrame, number: Column) -> DataFrame:
    return pages.withColumn("has_next", h.has_next_page(F.col("page"), number))
