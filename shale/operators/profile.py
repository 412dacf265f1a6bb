"""Request profile of a site: paths, parameters, samples, and the contract that they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shale import storage
from shale.functions import text as tx
from shale.functions import urls
from shale.operators import html as h

#: Parameter names by role. Fixed values.
PAGE_NAMES = ("page", "paged", "p", "pageno", "page_no")
CATEGORY_NAMES = ("cate_code", "cat1", "cat2", "ca_id", "mtype", "bo_table", "gr_id", "bcate", "scate")
SEARCH_NAMES = (
    "find", "find1", "find2", "find3", "find4", "search", "stx", "sfl", "sop", "syear", "eyear", "mkco", "maker", "model", "area", "price", "min_price",
    "max_price", "category", "keyword", "q", "smaker", "mimaker", "mmodel", "msort", "search_value", "skeyword",
)
DETAIL_NAMES = ("pid", "wr_id", "idx", "it_id", "product_no", "no", "seq", "uid", "id")
DETAIL_PATH = r"(?i)_v-\d+|/view/|/read/"
SAMPLES, PATHS, PARAMS, SHOWN = 6, 15, 30, 80


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, url, text, path, params) of all http links of parsed pages, click targets included, in the elements' order."""
    rows = pages.select(key, F.col("url").alias("base"), F.posexplode("page.targets").alias("pos", "a"))
    rows = rows.select(key, "pos", urls.absolute(F.col("base"), tx.stripped(F.col("a.target"))).alias("url"), F.substr("a.label", F.lit(1), F.lit(160)).alias("text"))
    return with_params(rows.where(urls.part(F.col("url"), 1).isin("http", "https")))


def with_params(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"host": urls.host_key(F.col("url")), "path": urls.part(F.col("url"), 3), "params": urls.params(F.col("url"))})


def on_hosts(rows: DataFrame, hosts: list[str]) -> DataFrame:
    """Links to the listed hosts; all links if there are none listed."""
    return rows.where(F.col("host").isin([x.lower().replace("www.", "") for x in hosts])) if hosts else rows


def names(column: str = "params") -> Column:
    return F.map_keys(column)


def is_pagination(n: Column) -> Column:
    return urls.has_name(n, PAGE_NAMES, "PB_")


#: Names of links that choose a category, and of links to details. Fixed values.
CATEGORY_LINK_NAMES = ("cate_code", "cat1", "cat2", "ca_id", "MType", "bo_table", "bcate", "scate")
DETAIL_LINK_NAMES = ("pid", "wr_id", "idx", "product_no", "no", "seq", "uid", "id")


def is_category(n: Column) -> Column:
    return urls.has_name(n, CATEGORY_LINK_NAMES, "SCH_category_", fold=False)


def is_detail(n: Column, path: Column) -> Column:
    return urls.has_name(n, DETAIL_LINK_NAMES) | path.rlike(DETAIL_PATH)


def _ranked(counts: DataFrame, group: list[str], most: int) -> DataFrame:
    """The most frequent of each group; of equals the one seen first."""
    order = [F.desc("count"), "first_seen"]
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


def path_frequency(rows: DataFrame, group: str, seen: list[str], most: int = PATHS) -> DataFrame:
    return _ranked(rows.groupBy(group, "path").agg(F.count("*").alias("count"), F.min(F.struct(*seen)).alias("first_seen")), [group], most)


def param_frequency(rows: DataFrame, group: str, seen: list[str], most: int = PARAMS) -> DataFrame:
    """A parameter counts once for each link."""
    each = rows.select(group, F.posexplode(names()).alias("k", "name"), *seen)
    return _ranked(each.groupBy(group, "name").agg(F.count("*").alias("count"), F.min(F.struct(*seen, "k")).alias("first_seen")), [group], most)


def path_samples(rows: DataFrame, group: str, seen: list[str], most: int = SAMPLES) -> DataFrame:
    """The first links of each path."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, "path").orderBy(*seen))).where(F.col("rank") <= most)


def weighted_params(fields: DataFrame, frequency: DataFrame, group: str) -> DataFrame:
    """(group, name, weight, place): 2 for each form field and 1 for each link with it; the place where the name comes up first.

    fields (group, name, place) come before all links; frequency: of :func:`param_frequency`, whose order the links' names have.
    """
    place = lambda of, at: F.struct(F.lit(of).alias("of"), at.cast("long").alias("at"))
    of_fields = fields.select(group, "name", F.lit(2).cast("long").alias("w"), place(0, F.col("place")).alias("place"))
    both = of_fields.unionByName(frequency.select(group, "name", F.col("count").alias("w"), place(1, F.col("rank")).alias("place")))
    return both.groupBy(group, "name").agg(F.sum("w").alias("weight"), F.min("place").alias("place"))


def roles(name: Column) -> Column:
    """The roles that a parameter's name suggests."""
    low = F.lower(name)
    found = F.array(
        F.when(low.isin(*PAGE_NAMES) | name.startswith("PB_"), "pagination"),
        F.when(low.isin(*CATEGORY_NAMES) | name.startswith("SCH_category_"), "category"),
        F.when(low.isin(*SEARCH_NAMES) | name.startswith("SCH_"), "search"),
        F.when(low.isin(*DETAIL_NAMES), "detail"),
    )
    return F.array_compact(found)


def contract(pages: DataFrame, group: str = "page_id", hosts: list[str] | None = None) -> DataFrame:
    """One row for each parsed page: endpoint, response type, ranked names, and names by role."""
    # Links, fields and hints read the pages three times: they are parsed once, and only these parts are stored.
    kept = [c for c in (group, "url", "content_type") if c in pages.columns]
    parts = F.struct(*[F.col(f"page.{c}").alias(c) for c in ("targets", "forms", "scripts")])
    pages = storage.stored(pages.select(*kept, parts.alias("page")), "profile")
    rows = on_hosts(links(pages, group), hosts or [])
    fields = pages.select(group, F.posexplode(F.flatten(F.transform("page.forms", lambda f: f["fields"]))).alias("place", "x")).select(group, "place", F.col("x.name").alias("name"))
    weights = weighted_params(fields, param_frequency(rows, group, ["pos"]), group)
    top = weights.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "place"))).where(F.col("rank") <= SHOWN)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "name", roles(F.col("name")).alias("roles"))))
    by = top.groupBy(group).agg(ordered.alias("_n"))
    details = rows.where(is_detail(names(), F.col("path"))).groupBy(group).agg(F.count("*").alias("_details"))
    role = lambda r: F.transform(F.filter(F.coalesce("_n", F.array().cast("array<struct<rank:int,name:string,roles:array<string>>>")), lambda x: F.array_contains(x["roles"], r)), lambda x: x["name"])
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit(""))) if "content_type" in pages.columns else F.lit("")
    hints = h.endpoint_hints(F.col("page"), F.col("url"))
    own_details = role("detail")
    return pages.join(by, group, "left").join(details, group, "left").select(
        group,
        urls.base_endpoint(F.col("url")).alias("base_endpoint"),
        urls.params(F.col("url")).alias("current_query_params"),
        F.slice(F.transform(F.coalesce("_n", F.array().cast("array<struct<rank:int,name:string,roles:array<string>>>")), lambda x: x["name"]), 1, 40).alias("observed_param_names_ranked"),
        F.when(kind.contains("json"), "JSON/API").when(F.size(hints) > 0, "HTML 목록 + JS/Ajax 단서").otherwise("HTML").alias("response_type"),
        role("pagination").alias("likely_pagination_params"),
        role("category").alias("likely_category_params"),
        role("search").alias("likely_search_filter_params"),
        F.when((F.size(own_details) == 0) & (F.col("_details") > 0), F.array(F.lit("path_suffix_id"))).otherwise(own_details).alias("likely_detail_id_params"),
    )


def link_samples(rows: DataFrame, group: str, kind: str, seen: list[str], most: int = 30) -> DataFrame:
    """The first links that page ('pagination') or choose a category ('category')."""
    test = {"pagination": is_pagination, "category": is_category}[kind]
    return rows.where(test(names())).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*seen))).where(F.col("rank") <= most)


def pages_to_sample(rows: DataFrame, group: str, seen: list[str]) -> DataFrame:
    """(group, url, rank): the first 3 pagination and 5 category links, each URL once. Fetching them is left to a crawler."""
    parts = [link_samples(rows, group, kind, seen, n).select(group, "url", (F.col("rank") + by).alias("rank")) for kind, n, by in (("pagination", 3, 0), ("category", 5, 3))]
    return parts[0].unionByName(parts[1]).groupBy(group, "url").agg(F.min("rank").alias("rank"))
