"""All queries of the listing engine with their DuckDB counterparts, over the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.functions import urls
from shale import sources, storage, streaming
from shale.operators import board, dictionary, html, identity, origins, owners, profile, site_report, survey
from shale.operators import listings as ls
from shale.operators import tasks as tk
from shale.plans import fixtures as fx
from shale.sources import files, sinks, store, table

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "1998-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


L, T, E = fx.duck(fx.LISTINGS_SQL), fx.duck(fx.TASKS_SQL), fx.duck(fx.TRANSITIONS_SQL)
SHOWN = ("id", "display_name", "model", "site", "site_short", "link", "price_krw::double as price_krw", "made_ym::double as made_ym", "operating_hours::double as operating_hours")
#: Whole numbers that may be missing are compared as doubles: both engines show them alike.


def _shown() -> list:
    return [F.col(c) for c in ("id", "display_name", "model", "site", "site_short", "link")] + [F.col(c).cast("double").alias(c) for c in ("price_krw", "made_ym", "operating_hours")]


DUCK_HOURS = r"'(\d{{1,3}}(?:[, ]?\d{{3}})+|\d{{3,6}})\s*(?:시간|hr|hrs|hour|hours|h\b)'".replace("{{", "{").replace("}}", "}")


def _hours(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, {DUCK_HOURS}, 1, 'i'), lambda n: try_cast(regexp_replace(n, '[^0-9]', '', 'g') as bigint)), lambda n: n >= 100)[1]"


NORMALIZED = f"""
select *, coalesce(nullif(listing_name, ''), '-') as display_name, coalesce(nullif(model_norm, ''), nullif(model_name, ''), '') as model, coalesce(nullif(source_site, ''), nullif(origin, ''), '-') as site,
  case when coalesce(nullif(source_site, ''), origin) like '%그린%' then '그린' when coalesce(nullif(source_site, ''), origin) like '%Mascus%' then 'Mascus'
    else lower(split_part(regexp_replace(regexp_extract(coalesce(nullif(origin, ''), nullif(detail_url, ''), crawl_url), '//([^/?#]*)', 1), '^www\\.', ''), '.', 1)) end as site_short,
  coalesce(nullif(detail_url, ''), crawl_url) as link,
  case when regexp_matches(manufactured_ym, '(19|20)\\d{{2}}') and coalesce(nullif(regexp_extract(regexp_extract(manufactured_ym, '(?:19|20)\\d{{2}}(.*)$', 1), '(\\d{{1,2}})', 1), '')::int, 1) between 1 and 12
    then regexp_extract(manufactured_ym, '((?:19|20)\\d{{2}})', 1)::int * 100 + coalesce(nullif(regexp_extract(regexp_extract(manufactured_ym, '(?:19|20)\\d{{2}}(.*)$', 1), '(\\d{{1,2}})', 1), '')::int, 1) end as made_ym,
  coalesce(case when not coalesce(json_valid(raw_json), false) then {_hours('raw_json')} else coalesce({_hours("raw_json ->> '$.detail.가동시간'")}, {_hours("raw_json ->> '$.detail.memo'")}) end,
    {_hours('description')}, {_hours('listing_name')}, {_hours('model_name')}) as operating_hours,
  coalesce(posted_at, posted_date::timestamp) as posted_key
from"""

STORE = {
    "posted_desc": "posted_at desc nulls last, posted_date desc nulls last, crawled_at desc nulls last, id desc",
    "posted_asc": "posted_at asc nulls last, posted_date asc nulls first, crawled_at desc nulls last, id desc",
    "price_desc": "price_krw desc nulls last, posted_at desc nulls last, id desc",
    "price_asc": "price_krw asc nulls last, posted_at desc nulls last, id desc",
}
FINAL = {"posted_desc": "posted_key desc nulls last", "posted_asc": "posted_key asc nulls first", "price_desc": "nullif(price_krw, 0) desc nulls last", "price_asc": "price_krw asc nulls last"}


def search_sql(sort: str, where: str = "true", ranges: str = "true", limit: int = 1000, before: int = ls.PRE_LIMIT) -> str:
    order = f"{FINAL[sort]}, {STORE[sort]}"
    return f"""
with l as ({L}), h as (select * from l where {where} order by {STORE[sort]} limit {before}), n as ({NORMALIZED} h),
a as (select * from n where {ranges} order by {order} limit {limit})
select row_number() over (order by {order}) as rank, {', '.join(SHOWN)} from a"""


def _answer(spark: SparkSession, d: str, p: ls.Search, before: int = ls.PRE_LIMIT) -> DataFrame:
    rows = ls.search(fx.listings(spark, d), p, before)
    # At most ls.MOST rows are left to number.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*ls.final_order(p.sort))).cast("long")).select("rank", *_shown())


SEARCH = ls.Search(q="machinery", date_from="1995-02-01", date_to="1998-10-31", price_from="20,000", price_to="400000", limit=300)
query("listing_search", search_sql("posted_desc", "(listing_name ilike '%machinery%' or model_name ilike '%machinery%' or coalesce(model_norm, '') ilike '%machinery%' or description ilike '%machinery%' or price ilike '%machinery%' or contact ilike '%machinery%' or manufacturer ilike '%machinery%' or location ilike '%machinery%' or seller ilike '%machinery%' or category_name ilike '%machinery%' or source_site ilike '%machinery%' or origin ilike '%machinery%') and posted_date between date '1995-02-01' and date '1998-10-31' and price_krw between 20000 and 400000", limit=300))(lambda s, d: _answer(s, d, SEARCH))
query("listing_search_wildcard", search_sql("posted_desc", "(listing_name ilike '%b_i%1%' or model_name ilike '%b_i%1%' or coalesce(model_norm, '') ilike '%b_i%1%' or description ilike '%b_i%1%' or price ilike '%b_i%1%' or contact ilike '%b_i%1%' or manufacturer ilike '%b_i%1%' or location ilike '%b_i%1%' or seller ilike '%b_i%1%' or category_name ilike '%b_i%1%' or source_site ilike '%b_i%1%' or origin ilike '%b_i%1%')", limit=1000))(lambda s, d: _answer(s, d, ls.Search(q=" b_i%1 ")))
for _sort in STORE:
    query(f"order_{_sort}", search_sql(_sort, limit=400))(lambda s, d, sort=_sort: _answer(s, d, ls.Search(sort=sort, limit="400")))
query("filter_after_limit", search_sql("posted_desc", ranges="made_ym between 199506 and 201012 and operating_hours >= 600", limit=1000, before=5000))(
    lambda s, d: _answer(s, d, ls.Search(made_from="1995-06", made_to="2010-12", hours_from="600"), 5000)
)
query("listing_stats", f"with l as ({L}) select count(*) as total, count(price_krw) as priced, max(posted_date)::string as latest from l")(lambda s, d: ls.stats(fx.listings(s, d)).withColumn("latest", F.col("latest").cast("string")))


@query("listing_normalized", f"with l as ({L}), n as ({NORMALIZED} l) select {', '.join(SHOWN)} from n")
def listing_normalized(s, d):
    return ls.normalized(fx.listings(s, d)).select(*_shown())


# --- scalars ---

PRICES = "case p_partkey % 6 when 0 then concat(cast(p_partkey as string), ',500만원') when 1 then concat(cast(p_partkey % 9 as string), '.15억') when 2 then concat('1억 ', cast(p_partkey as string), '만원') when 3 then concat(cast(p_partkey as string), '천원') when 4 then '가격문의 5000' else concat('약 ', cast(p_retailprice as string)) end"


@query("price_parse", f"""with t as (select p_partkey, {PRICES} as price from part), n as (select *, try_cast(replace(regexp_extract(price, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') as double) as n from t)
select p_partkey, price, case when not regexp_matches(price, '협의|문의|상담') then trunc(n * case when price like '%억%' then 100000000.0 when price like '%만원%' then 10000.0 when price like '%천원%' then 1000.0 else 1.0 end)::bigint::double end as price_krw from n""")
def price_parse(s, d):
    return table(s, d, "part").withColumn("price", F.expr(PRICES)).select("p_partkey", "price", tx.price_krw(F.col("price")).cast("double").alias("price_krw"))


DATES = "case o_orderkey % 6 when 0 then strf1 when 1 then concat(y, '.', m, '.', dd) when 2 then concat(substr(y, 3, 2), '/', m, '/', dd) when 3 then concat(m, '-', dd) when 4 then concat(y, lpad(m, 2, '0'), lpad(dd, 2, '0')) else 'unknown' end"
_YMD = "cast(year(o_orderdate) as string) as y, cast(month(o_orderdate) as string) as m, cast(day(o_orderdate) as string) as dd"


@query("date_parse", f"""with a as (select o_orderkey, o_orderdate, {_YMD} from orders), t as (select o_orderkey, o_orderdate, concat(y, '-', m, '-', dd, ' 7:05') as strf1, y, m, dd from a)
select o_orderkey, {DATES} as raw, case o_orderkey % 6 when 5 then null when 3 then try_cast(concat('1998-', lpad(m, 2, '0'), '-', lpad(dd, 2, '0')) as timestamp) when 0 then date_trunc('day', o_orderdate) + interval '7 hours 5 minutes' when 2 then try_cast(concat('20', substr(y, 3, 2), '-', lpad(m, 2, '0'), '-', lpad(dd, 2, '0')) as timestamp) else date_trunc('day', o_orderdate) end as posted_at from t""")
def date_parse(s, d):
    t = table(s, d, "orders").selectExpr("o_orderkey", "o_orderdate", *_YMD.split(", ")).withColumn("strf1", F.expr("concat(y, '-', m, '-', dd, ' 7:05')"))
    return t.withColumn("raw", F.expr(DATES)).select("o_orderkey", "raw", tx.site_date(F.col("raw"), F.lit(NOW).cast("timestamp_ntz")).alias("posted_at"))


@query("period_filter", f"select count(*) as kept, min(o_orderdate) as first from orders where o_orderdate >= timestamp '{NOW}' - interval 30 day")
def period_filter(s, d):
    kept = table(s, d, "orders").where(tx.in_period(F.col("o_orderdate"), "최근1달", F.lit(NOW).cast("timestamp_ntz")))
    return kept.agg(F.count("*").alias("kept"), F.min("o_orderdate").alias("first"))


@query("clean_text", r"select doc_id, sha256(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g'))) as cleaned from documents")
def clean_text(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(tx.clean_text(F.col("text")), 256).alias("cleaned"))


@query("redacted", r"select event_id, concat('see http', case when event_id % 2 = 0 then '://***:***@' else '://' end, 'h.example.com') as redacted from events")
def redacted(s, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("see http://u"), F.col("user_id"), F.lit(":pw@h.example.com"))).otherwise("see http://h.example.com")
    return table(s, d, "events").select("event_id", tx.redact(raw).alias("redacted"))


PHONE_SQL = "regexp_extract_all(contact, '(?:\\+?82[-.\\s]*)?0?\\d{1,2}[-.\\s]*\\d{3,4}[-.\\s]*\\d{4}')"
NUMBERS = f"list_filter(list_transform({PHONE_SQL}, lambda x: case when regexp_replace(x, '[^0-9]', '', 'g') like '82%' and length(regexp_replace(x, '[^0-9]', '', 'g')) >= 11 then '0' || substr(regexp_replace(x, '[^0-9]', '', 'g'), 3) else regexp_replace(x, '[^0-9]', '', 'g') end), lambda x: regexp_full_match(x, '0\\d{{8,10}}') and not regexp_full_match(x, '0+'))".replace("{{", "{").replace("}}", "}")
DISPLAY = "case when regexp_full_match(phone, '01\\d{9}') then concat(phone[1:3], '-', phone[4:7], '-', phone[8:]) when regexp_full_match(phone, '01\\d{8}') then concat(phone[1:3], '-', phone[4:6], '-', phone[7:]) when regexp_full_match(phone, '0\\d{9}') then concat(phone[1:2], '-', phone[3:6], '-', phone[7:]) else concat(phone[1:3], '-', phone[4:7], '-', phone[8:]) end"


@query("phone_extract", f"with l as ({L}) select id, array_to_string(list_distinct({NUMBERS}).list_sort(), ',') as phones from l")
def phone_extract(s, d):
    return fx.listings(s, d).select("id", F.array_join(F.array_sort(tx.phones(F.col("contact"))), ",").alias("phones"))


def owner_sql(where: str = "true", limit: int = 1000) -> str:
    first = lambda c, n: f"(select array_to_string(list(v order by o)[1:{n}], ', ') from (select {c} as v, min(o) as o from x where x.phone = p.phone and coalesce({c}, '') <> '' group by {c}))"
    return f"""
with l as ({L}), n as ({NORMALIZED} l), r as (select *, row_number() over (order by posted_at desc nulls last, id desc) as o from n where trim(contact) <> ''),
x as (select distinct r.*, unnest({NUMBERS}) as phone from r),
p as (select phone, count(distinct id) as listing_count, max(coalesce(strftime(posted_at, '%Y-%m-%d %H:%M:%S'), posted_date::string)) as latest_posted, max(crawled_at) as latest_crawled, {DISPLAY} as phone_display from x group by phone),
q as (select *, {first('seller', 3)} as sellers, {first('site_short', 4)} as sites from p)
select phone, listing_count, latest_posted, latest_crawled, sellers, sites, phone_display from q where {where} order by listing_count desc, latest_posted desc nulls last, phone limit {limit}"""


query("owner_rollup", owner_sql())(lambda s, d: owners.roll_up(owners.source_rows(fx.listings(s, d))))
query("owner_search", owner_sql("contains(lower(concat_ws(' ', phone, phone_display, sellers, sites)), '010-0003')", 5))(lambda s, d: owners.roll_up(owners.source_rows(fx.listings(s, d)), "010-0003", 5))


@query("owner_detail", f"with l as ({L}), n as ({NORMALIZED} l) select id, display_name, seller from n where list_contains({NUMBERS}, '01000030003')")
def owner_detail(s, d):
    return owners.listings_of(fx.listings(s, d), "+82 10 0003 0003").select("id", "display_name", "seller")


@query("owner_counts", f"with l as ({L}), x as (select id, unnest({NUMBERS}) as phone from l) select count(distinct id) as listing_with_phone_count, count(distinct phone) as owner_count from x")
def owner_counts(s, d):
    return owners.counts(fx.listings(s, d))


# --- identity ---

HASH_SQL = "sha256('{\"contact\":\"' || contact || '\",\"detail_url\":\"' || detail_url || '\",\"listing_name\":\"' || listing_name || '\",\"model_name\":\"' || model_name || '\",\"origin\":\"' || origin || '\",\"posted_at\":\"' || coalesce(strftime(posted_at, '%Y-%m-%d %H:%M:%S'), '') || '\",\"posted_date\":\"' || coalesce(posted_date::string, '') || '\",\"price\":\"' || price || '\"}')"
query("content_hash", f"with l as ({L}) select id, {HASH_SQL} as content_hash, sha256(crawl_url) as url_hash from l")(
    lambda s, d: fx.listings(s, d).select("id", identity.content_hash().alias("content_hash"), urls.url_hash(F.col("crawl_url")).alias("url_hash"))
)


def _hash_key():
    return F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("h"), F.col("user_id")))


@query("latest_wins_merge", """with e as (select event_id, case when user_id % 10 > 0 then concat('h', user_id) end as content_hash, event_type as listing_name, value, ts, event_id >= (select max(event_id) // 2 from events) as late from events),
k as (select content_hash, arg_max(listing_name, event_id) as listing_name, arg_max(value, event_id) as value, min(event_id) as id, min(ts) as created_at, case when bool_or(late) then timestamp '2030-01-01' else arg_max(ts, event_id) end as updated_at from e where content_hash is not null group by content_hash)
select id, content_hash, listing_name, value, created_at, updated_at from k union all select event_id, null, listing_name, value, ts, ts from e where content_hash is null""")
def latest_wins_merge(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), _hash_key().alias("content_hash"), F.col("event_type").alias("listing_name"), "value", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.col("event_id").alias("_at"))
    half = e.agg(F.floor(F.max("id") / 2)).first()[0]
    old = e.where((F.col("id") < half) & F.col("content_hash").isNotNull())
    # The first half is folded into an existing store, the rest is merged into it.
    store = identity.merge_latest(old.limit(0).drop("_at"), old, "content_hash", "_at").unionByName(e.where((F.col("id") < half) & F.col("content_hash").isNull()).drop("_at"))
    return identity.merge_latest(store, e.where(F.col("id") >= half), "content_hash", "_at", stamp=F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


@query("bucket_store_merge", ORACLES["latest_wins_merge"])
def bucket_store_merge(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), _hash_key().alias("content_hash"), F.col("event_type").alias("listing_name"), "value", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.col("event_id").alias("_at"))
    half = e.agg(F.floor(F.max("id") / 2)).first()[0]
    at = storage.new_path(s, "store")
    store.merge(e.where(F.col("id") < half), at, "content_hash", "_at", "first", buckets=8)
    store.merge(e.where(F.col("id") >= half), at, "content_hash", "_at", "second", stamp=F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    # Rows without a key are stamped by nobody.
    return store.read(s, at, e.drop("_at").schema)


@query("first_wins", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def first_wins(s, d):
    return identity.first_by(table(s, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


# --- tasks ---

query("task_eligible", f"with t as ({T}) select id, priority from t where status = 'pending' and (next_run_at is null or next_run_at <= timestamp '{NOW}') order by priority, id limit 20")(
    lambda s, d: tk.eligible(fx.tasks(s, d), F.lit(NOW).cast("timestamp_ntz")).select("id", "priority")
)
query("task_summary", f"with t as ({T}) select count(*) as total, max(coalesce(success_at, updated_at, created_at)) as latest from t where status = 'done' and site_slug = 'green_heavy'")(
    lambda s, d: tk.summary(tk.task_filter(fx.tasks(s, d), status="done", site="green_heavy"))
)
for _name, _keys in (("task_count_by_status", ("status",)), ("task_count_by_site", ("site_slug",)), ("queue_counts", ("site_slug", "status"))):
    query(_name, f"with t as ({T}) select {', '.join(_keys)}, count(*) as count, max(coalesce(success_at, updated_at, created_at)) as latest from t group by all")(lambda s, d, keys=_keys: tk.counts_by(fx.tasks(s, d), *keys))
query("status_pivot", f"with t as ({T}) select site_slug, count_if(status = 'running')::bigint as running, count_if(status = 'pending')::bigint as pending, count_if(status = 'done')::bigint as done from t group by all")(
    lambda s, d: tk.status_pivot(fx.tasks(s, d), "site_slug")
)


@query("task_view", f"""with t as ({T}), v as (select *, coalesce(success_at, updated_at, created_at) as last_crawled_at, coalesce(list_position(['running', 'pending', 'done'], status), 0)::int as status_order from t where url ilike '%9%')
select id, status, status_order, last_crawled_at, case site_slug when 'green_heavy' then '그린중기' when 'mascus_korea' then 'Mascus' when '' then origin else site_slug end as site from v order by status_order, last_crawled_at desc nulls last, id desc limit 700""")
def task_view(s, d):
    return tk.view(fx.tasks(s, d), 700, q="9").select("id", "status", F.col("status_order").cast("int").alias("status_order"), "last_crawled_at", tk.site_name(F.col("site_slug"), F.col("origin")).alias("site"))


@query("task_recovered", f"with t as ({T}) select case when status = 'running' and updated_at <= timestamp '{NOW}' - interval 3600 second then 'pending' else status end as status, count(*) as n from t group by all")
def task_recovered(s, d):
    return tk.recovered(fx.tasks(s, d), F.lit(NOW).cast("timestamp_ntz"), 3600).groupBy("status").agg(F.count("*").alias("n"))


@query("task_fold", f"""with recursive e as (select *, row_number() over (partition by user_id order by seq) as k from ({E})),
f as (select user_id, 0::bigint as k, null::string as status, 0 as attempts, null::int as last_status_code, null::string as last_error, null::timestamp as success_at, null::timestamp as next_run_at from (select distinct user_id from e)
union all select f.user_id, e.k,
  case when e.kind in ('enqueue', 'enqueue_reset') and f.status = 'running' then 'running' when e.kind = 'enqueue' and f.status = 'done' then 'done' when e.kind in ('enqueue', 'enqueue_reset') then 'pending'
    when e.kind = 'start' then 'running' when e.kind = 'done' then 'done' when e.kind = 'retry' then 'pending' when e.kind = 'recover' and f.status = 'running' then 'pending' else f.status end,
  case when e.kind = 'enqueue_reset' and coalesce(f.status, '') <> 'running' then 0 when e.kind = 'retry' then f.attempts + 1 else f.attempts end,
  case when e.kind in ('enqueue', 'enqueue_reset', 'done') then null when e.kind = 'retry' then e.code else f.last_status_code end,
  case when e.kind in ('enqueue', 'enqueue_reset', 'done') then null when e.kind = 'retry' then e.error else f.last_error end,
  case when e.kind = 'done' then e.at when e.kind = 'enqueue_reset' and coalesce(f.status, '') <> 'running' then null else f.success_at end,
  case when e.kind in ('enqueue', 'enqueue_reset', 'done') then null when e.kind = 'retry' then e.at + to_seconds(e.wait) else f.next_run_at end
from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, status, attempts, last_status_code::double as last_status_code, last_error, success_at, next_run_at from f qualify row_number() over (partition by user_id order by k desc) = 1""")
def task_fold(s, d):
    out = tk.fold(fx.transitions(s, d), ["user_id"], ["seq"])
    return out.select("user_id", "status", "attempts", F.col("last_status_code").cast("double").alias("last_status_code"), "last_error", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("success_at", "next_run_at")])


@query("back_off", "select event_id, case when event_id % 3 = 0 then 900 else greatest(60, floor(20 * value))::int end as wait from events")
def back_off(s, d):
    code = F.when(F.col("event_id") % 3 == 0, 400).otherwise(500)
    return table(s, d, "events").select("event_id", tk.back_off(code, F.col("value")).alias("wait"))


@query("empty_page_stop", """with p as (select user_id, row_number() over (partition by user_id order by event_id) as page, case when value > 30 then 1 else 0 end as found from events),
i as (select *, sum(found) over (partition by user_id order by page) as island from p), e as (select *, sum(1 - found) over (partition by user_id, island order by page) as empties from i),
s as (select user_id, min(page) filter (where empties > 2) as stop from e group by user_id) select p.user_id, count(*) as pages, sum(found)::bigint as found from p join s using (user_id) where stop is null or page <= stop group by p.user_id""")
def empty_page_stop(s, d):
    pages = table(s, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("page"), F.when(F.col("value") > 30, 1).otherwise(0).alias("found"))
    return tk.pages_read(pages, ["user_id"], "page", "found").groupBy("user_id").agg(F.count("*").alias("pages"), F.sum("found").cast("long").alias("found"))


# --- URLs and profile ---

HOST = "replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'www.', '')"
BARE = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"


@query("url_keys", f"select page_id, {HOST} as host, concat(regexp_extract(url, '^([a-z]+):', 1), '://', {BARE}) as origin, concat('//', {BARE}, coalesce(nullif({PATH}, ''), '/'), case when {QUERY} <> '' then concat('?', {QUERY}) else '' end) as key, regexp_replace({HOST}, '[^0-9A-Za-z가-힣._-]+', '_', 'g') as file from pages")
def url_keys(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", urls.host_key(u).alias("host"), urls.origin_key(u).alias("origin"), urls.canonical_url_key(u).alias("key"), tx.safe_name(urls.host_key(u)).alias("file"))


@query("url_split", "select page_id, concat(url, ' http://www.x.example.com https://www.y.example.com') as urls from pages")
def url_split(s, d):
    a = urls.split_urls(F.concat(F.col("url"), F.lit(" ; http://www.x.example.com")))
    return table(s, d, "pages").select("page_id", F.array_join(F.array_distinct(F.concat(a, urls.split_urls(F.lit("www.y.example.com;;")))), " ").alias("urls"))


@query("url_param_frequency", f"""with p as (select page_id, {HOST} as host, unnest(list_distinct(list_transform(list_filter(string_split({QUERY}, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)))) as name from pages),
c as (select host, name, count(*) as count, min(page_id) as f from p group by all) select host, name, count, row_number() over (partition by host order by count desc, f, name) as rank from c qualify rank <= 30""")
def url_param_frequency(s, d):
    rows = profile.with_params(table(s, d, "pages")).withColumn("at", F.col("page_id"))
    counts = profile.param_frequency(rows, "host", ["at"])
    return counts.select("host", "name", "count", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("count"), "first_seen.at", "name")).cast("long").alias("rank"))


@query("path_frequency", f"select host, path, count(*) as count, min(page_id) as first_page from (select page_id, {HOST} as host, regexp_replace({PATH}, '[0-9]+', 'N', 'g') as path from pages) group by host, path qualify row_number() over (partition by host order by count(*) desc, min(page_id)) <= 15")
def path_frequency(s, d):
    rows = profile.with_params(table(s, d, "pages")).withColumn("path", F.regexp_replace("path", "[0-9]+", "N"))
    return profile.path_frequency(rows, "host", ["page_id"]).select("host", "path", "count", F.col("first_seen.page_id").alias("first_page"))


@query("path_samples", f"select host, lang, page_id, row_number() over (partition by host, lang order by page_id) as rank from (select page_id, {HOST} as host, split_part({PATH}, '/', 2) as lang from pages) qualify rank <= 6")
def path_samples(s, d):
    rows = table(s, d, "pages").select("page_id", urls.host_key(F.col("url")).alias("host"), F.split_part(urls.part(F.col("url"), 3), F.lit("/"), F.lit(2)).alias("path"))
    return profile.path_samples(rows, "host", ["page_id"]).select("host", F.col("path").alias("lang"), "page_id", F.col("rank").cast("long").alias("rank"))


@query("weighted_params", f"""with p as (select {HOST} as host, unnest(list_transform(list_filter(string_split({QUERY}, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1))) as name from pages),
u as (select host, name, 1 as w from p union all select distinct {HOST}, 'stx', 2 from pages) select host, name, sum(w)::bigint as weight, concat_ws(',', case when name = 'page' then 'pagination' end, case when name = 'stx' then 'search' end) as roles from u group by host, name""")
def weighted_params(s, d):
    rows = profile.with_params(table(s, d, "pages"))
    fields = rows.select("host", F.lit("stx").alias("name"), F.lit(0).alias("place")).distinct()
    out = profile.weighted_params(fields, profile.param_frequency(rows, "host", ["page_id"]), "host")
    return out.drop("place").withColumn("roles", F.array_join(profile.roles(F.col("name")), ","))


# --- dictionary ---

MODELS = "select p_partkey as pos, concat(upper(p_type), '-', cast(p_partkey % 150 as string), case when p_partkey % 2 = 0 then 'X' else '' end) as value from part"
TEXTS = "select o_orderkey as id, case o_orderkey % 3 when 0 then concat('used ', lower(o_orderpriority), ' economy ', cast(o_orderkey % 160 as string), 'x new') when 1 then concat('Small-', cast(o_orderkey % 150 as string)) else concat(o_orderstatus, 'promo', cast(o_orderkey % 12 as string)) end as name from orders"


@query("model_match", f"""with k as (select regexp_replace(value, '[^0-9A-Z가-힣]', '', 'g') as key, value, pos from ({MODELS})), e as (select key, arg_max(value, pos) as canonical, min(pos) as ord from k group by key),
t as (select id, regexp_replace(upper(name), '[^0-9A-Z가-힣]', '', 'g') as key from ({TEXTS})), x as (select distinct key from t),
m as (select x.key, coalesce(max(e.canonical) filter (where e.key = x.key), arg_max(e.canonical, length(e.key) * 1000000 - e.ord) filter (where length(e.key) >= 4)) as model_norm from x join e on contains(x.key, e.key) group by x.key)
select t.id, m.model_norm from t left join m using (key)""")
def model_match(s, d):
    entries = dictionary.from_values(table(s, d, "part").selectExpr(*_columns(MODELS)))
    return dictionary.match(table(s, d, "orders").selectExpr(*_columns(TEXTS)), "name", entries).select("id", "model_norm")


def _columns(sql: str) -> list[str]:
    body = sql[len("select ") : sql.rindex(" from ")]
    first, rest = body.split(", ", 1)
    return [first, rest]


# --- survey ---


@query("origins_over", "select o_custkey, max(o_totalprice) as largest from orders group by 1 having max(o_totalprice) > 400000")
def origins_over(s, d):
    rows = survey.origins_over(table(s, d, "orders"), "o_custkey", "o_totalprice", 400_000)
    return rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("largest"))


@query("first_values", "with f as (select user_id, event_type, min(event_id) as o from events where event_type <> 'view' group by all), n as (select *, row_number() over (partition by user_id order by o) as n from f) select user_id, string_agg(event_type, ' | ' order by n) as first_values from n where n <= 3 group by user_id")
def first_values(s, d):
    rows = table(s, d, "events").withColumn("event_type", F.when(F.col("event_type") == "view", "NaN").otherwise(F.col("event_type")))
    return survey.first_values(rows, "user_id", "event_type", "event_id", 3)


#: The words of a listing page and those against it, spelt out once more for the SQL. Fixed values.
FOR_SQL = "매물 중고 판매 팝니다 보유 제품 장비 굴삭 굴착 지게차 덤프 로더 크레인 건설기계 product products goods shop sale sell used machine equipment board bbs sub6 sub8 m02"
AGAINST_SQL = "회사소개 인사말 오시는길 공지 공지사항 고객센터 자주하는질문 묻고답하기 질문 자유게시판 견적 문의 로그인 회원 채용 개인정보 약관 intro company notice contact login join"


def _hits_sql(text: str, words: str, weight: int) -> str:
    return "(" + " + ".join(f"case when contains({text}, '{w}') then {weight} else 0 end" for w in words.split()) + ")"


SCORED = f"select page_id, url, {HOST} as host, page_id % 300 as listing_count, page_id % 3 = 0 as listing_like, 10.0 + case when page_id % 3 = 0 then 25 else 0 end + least(page_id % 300, 200) / 10.0 + 2 + {_hits_sql('lower(url)', FOR_SQL, 3)} - {_hits_sql('lower(url)', AGAINST_SQL, 4)} as score from pages"


def _scored(s, d):
    p = table(s, d, "pages").select("page_id", "url", urls.host_key(F.col("url")).alias("host"), (F.col("page_id") % 300).alias("listing_count"), (F.col("page_id") % 3 == 0).alias("listing_like"))
    return p.withColumn("score", survey.page_score(F.lit(True), F.col("listing_like"), F.col("listing_count"), F.lit("HTML 응답"), F.col("url")))


@query("best_page", f"select host, page_id, round(score, 6) as score from ({SCORED}) qualify row_number() over (partition by host order by score desc, page_id) = 1")
def best_page(s, d):
    return survey.best_pages(_scored(s, d), "host", "page_id").select("host", "page_id", F.round("score", 6).alias("score"))


#: Texts with 0, 1 or 2 of the words, made from the page's number.
WORDED = "concat_ws(' ', case page_id % 3 when 0 then '팝니다' when 1 then 'nothing' else '견적' end, case page_id % 5 when 0 then '중고' when 1 then 'Machine' when 2 then '로그인' else 'text' end, case page_id % 7 when 0 then '12,000만원' when 1 then '2009 년' else '' end)"


@query("listing_like", f"""with t as (select page_id, {WORDED} as t from pages) select page_id, {_hits_sql('lower(t)', FOR_SQL, 1)} >= 2 or page_id % 7 < 2 or page_id % 11 = 0 as listing_like,
{_hits_sql('lower(t)', FOR_SQL, 4)} - {_hits_sql('lower(t)', AGAINST_SQL, 3)} + case when page_id % 11 = 0 then 3 else 0 end as link_score, contains(t, '견적') and page_id % 2 = 0 as off from t""")
def listing_like(s, d):
    p = table(s, d, "pages").select("page_id", F.expr(WORDED).alias("t"), F.when(F.col("page_id") % 11 == 0, "x?bo_table=q").otherwise("x").alias("u"))
    off = survey.no_inventory(F.when(F.col("page_id") % 2 == 0, "title").otherwise("굴삭기 매매"), F.replace("t", F.lit("견적"), F.lit("구인구직")), F.lit("x"))
    return p.select("page_id", survey.listing_like(F.col("t"), F.col("u")).alias("listing_like"), survey.link_score(F.col("t"), F.col("u")).cast("int").alias("link_score"), off.alias("off"))


SURVEYED = f"select concat('n', page_id) as name, url, listing_count, case when listing_like and listing_count > 0 then 'Y' when listing_like then '추정' else 'N' end as flag, page_id % 5 > 0 as original from ({SCORED})"
RANKED = f"select *, row_number() over (order by listing_count desc, flag = 'N', not original, name) as rank from ({SURVEYED})"


def _surveyed(s, d):
    return survey.ranked(_scored(s, d).select(F.concat(F.lit("n"), "page_id").alias("name"), "url", "listing_count", survey.flag(F.col("listing_like"), F.col("listing_count")).alias("flag"), (F.col("page_id") % 5 > 0).alias("original")))


query("survey_rank", f"select name, listing_count, flag, rank from ({RANKED})")(lambda s, d: _surveyed(s, d).select("name", "listing_count", "flag", F.col("rank").cast("long").alias("rank")))


@query("survey_summary", f"""with r as (select *, {HOST} as domain, concat('//', {BARE}, coalesce(nullif({PATH}, ''), '/'), case when {QUERY} <> '' then concat('?', {QUERY}) else '' end) as url_key from ({RANKED})),
g as (select domain, url_key, arg_min(name, rank) as n, arg_min(listing_count, rank) as listing_count, arg_min(flag, rank) as flag, count(*) as linked, string_agg(name, ' | ' order by rank) as linked_names from r group by all)
select domain, url_key, case when linked = 1 then n else concat(domain, ' 공용매물/플랫폼') end as name, listing_count, flag, linked, linked_names, row_number() over (order by listing_count desc, flag, domain, url_key) as rank from g""")
def survey_summary(s, d):
    return survey.summary(_surveyed(s, d)).drop("url").withColumn("rank", F.col("rank").cast("long"))


COUNTED = "case page_id % 4 when 0 then concat('총 게시물 ', cast(page_id * 7 % 500000 as string), ' 건') when 1 then concat('매물 수: 1,', lpad(cast(page_id % 1000 as string), 3, '0'), '대') when 2 then concat('전체보기 (', cast(page_id as string), ') 검색결과: 12건') else 'nothing' end"


@query("displayed_count", "select page_id, case page_id % 4 when 0 then (page_id * 7 % 500000)::double when 1 then (1000 + page_id % 1000)::double when 2 then 12 end as total, case when page_id % 4 = 3 then 7700::double else null end as estimate from pages")
def displayed_count(s, d):
    p = table(s, d, "pages").withColumn("t", F.expr(COUNTED))
    estimate = survey.estimated_count(F.lit(None).cast("int"), F.lit(110), F.lit(70))
    return p.select("page_id", survey.displayed_count(F.col("t")).cast("double").alias("total"), F.when(F.col("page_id") % 4 == 3, estimate).cast("double").alias("estimate"))


@query("union_rows", "select n_name as name, 'seed' as kind from nation union all select * from (values ('extra one', 'extra'), ('extra two', 'extra')) t(name, kind)")
def union_rows(s, d):
    extra = s.createDataFrame([("extra one",), ("extra two",)], "name string").withColumn("kind", F.lit("extra"))
    return table(s, d, "nation").select(F.col("n_name").alias("name"), F.lit("seed").alias("kind")).unionByName(extra, allowMissingColumns=True)


# --- HTML ---

LINKS = "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))"


@query("html_links", f"select page_id, count(*) as links, sha256(string_agg(href, ' ' order by href)) as hrefs from (select page_id, {LINKS} as href from pages) group by page_id")
def html_links(s, d):
    rows = html.with_page(table(s, d, "pages")).select("page_id", F.transform("page.links", lambda a: a["href"]).alias("h"))
    return rows.where(F.size("h") > 0).select("page_id", F.size("h").cast("long").alias("links"), F.sha2(F.array_join(F.array_sort("h"), " "), 256).alias("hrefs"))


def _characters(x: str) -> str:
    """The entities of the given pages as characters; '&amp;' last, and without its semicolon where a title was cut."""
    for entity, c in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">")):
        x = f"replace({x}, '&{entity};', '{c}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


#: The visible text of a page: comments, scripts and styles out, tags to blanks, entities to characters.
VISIBLE = f"""trim(regexp_replace({_characters("regexp_replace(regexp_replace(html, '<!--.*?-->|<(script|style|noscript)[ >].*?</(script|style|noscript)>|<!DOCTYPE[^>]*>', ' ', 'gs'), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"""
TITLE = f"""substring(trim(regexp_replace({_characters("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '\\s+', ' ', 'g')), 1, 120)"""


@query("html_titles", f"""select page_id, {TITLE} as title, sha256({VISIBLE}) as text_sha256, len(regexp_extract_all(html, '<script[ >]'))::double as scripts, 0::double as forms from pages""")
def html_titles(s, d):
    p = html.with_page(table(s, d, "pages"))
    return p.select("page_id", html.title(F.col("page")).alias("title"), F.sha2(F.col("page.text"), 256).alias("text_sha256"), F.size("page.scripts").cast("double").alias("scripts"), F.size("page.forms").cast("double").alias("forms"))


SHOPS = fx.duck(fx.SHOPS_SQL)
SHOP_HOST = "concat('http://www.shop', page_id % 7, '.example.com')"


@query("html_candidate_links", f"""select page_id, rank::double as rank, score::double as score, concat({SHOP_HOST}, href) as url, label from pages, (values (1, 25, '/bbs/board.php?bo_table=sale', '매물 게시판'), (2, 6, '/goods?page=2', 'next'),
(3, 6, '/sub6/1', 'sub6'), (4, 6, '/sub6/2', 'sub6'), (5, 6, '/sub6/3', 'sub6'), (6, 6, '/sub6/4', 'sub6'), (7, 6, '/sub6/5', 'sub6')) v(rank, score, href, label)""")
def html_candidate_links(s, d):
    return survey.candidate_links(html.with_page(fx.shops(s, d))).withColumns({c: F.col(c).cast("double") for c in ("rank", "score")})


@query("html_forms", f"select page_id, 1::double as form, 'POST' as method, concat({SHOP_HOST}, '/search') as action, 'stx:input:text:x:0 cate_code:select:::2' as fields, '1=One 2=Two' as options, '찾기 One Two' as text from pages")
def html_forms(s, d):
    f = html.with_page(fx.shops(s, d)).select("page_id", F.explode(html.forms(F.col("page"), F.col("url"))).alias("f")).select("page_id", "f.*")
    shown = F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["tag"], x["type"], x["value"], F.size(x["options"]).cast("string")))
    options = F.transform(F.flatten(F.transform("fields", lambda x: x["options"])), lambda o: F.concat_ws("=", o["value"], o["text"]))
    return f.select("page_id", F.col("index").cast("double").alias("form"), "method", "action", F.array_join(shown, " ").alias("fields"), F.array_join(options, " ").alias("options"), "text")


@query("html_scripts", f"""with s as ({SHOPS}), x as (select page_id, url, list_filter(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's'), lambda b: b <> '') as inline, regexp_extract_all(html, '<script src="([^"]*)"', 1) as external from s),
h as (select page_id, concat({SHOP_HOST}, unnest(list_concat(regexp_extract_all(array_to_string(inline, chr(10)), 'fetch\\("([^"]+)"', 1), regexp_extract_all(array_to_string(inline, chr(10)), 'url: "([^"]+)"', 1)))) as hint from x),
g as (select page_id, string_agg(distinct hint, ' ' order by hint) as hints from h group by page_id)
select page_id, len(external)::double as external, len(inline)::double as inline, concat({SHOP_HOST}, external[1]) as first_source, coalesce(hints, '') as hints from x left join g using (page_id)""")
def html_scripts(s, d):
    p = html.with_page(fx.shops(s, d))
    sources_, inline = html.script_sources(F.col("page"), F.col("url")), html.inline_scripts(F.col("page"))
    hints = F.array_join(html.endpoint_hints(F.col("page"), F.col("url")), " ")
    return p.select("page_id", F.size(sources_).cast("double").alias("external"), F.size(inline).cast("double").alias("inline"), F.get(sources_, F.lit(0)).alias("first_source"), hints.alias("hints"))


PAGE_OF = "list_max(list_transform(list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: case when h = '' or h like '#%' then url when h like '?%' then concat(split_part(url, '?', 1), h) else h end), lambda u: try_cast(regexp_extract(u, '[?&]page=([0-9]+)', 1) as int)))"


@query("page_analysis", f"""with s as ({SHOPS}),
p as (select page_id, url, {TITLE} as title, contains(html, '고객센터') and not regexp_matches(html, '<title> *굴삭기') as off, try_cast(regexp_extract(html, '총 게시물 ([0-9]+) 건', 1) as int) as total, {PAGE_OF} as page_max,
  len(list_distinct(regexp_extract_all(html, '<a href="(/item/[0-9]+)(?:#[^"]*)?">굴삭기', 1))) as seen, contains(html, 'fetch(') as scripted from s),
q as (select *, case when off then 0 else seen end as visible, case when off then 0 when total is not null then total when page_max > 1 then page_max * seen else seen end as n from p)
select page_id, title, case when not scripted then 'HTML 응답' when not off and (n > 0 or visible > 0) then 'HTML 응답(스크립트 단서 있음)' else 'HTML+API호출 단서' end as kind,
total::double as total, page_max::double as page_max, visible::double as visible, n::double as listing_count, not off as listing_like,
10 + case when off then 0 else 25 end + least(n, 200) / 10.0 + case when not scripted or (not off and (n > 0 or visible > 0)) then 2 else 0 end + {_hits_sql('lower(url)', FOR_SQL, 3)} - {_hits_sql('lower(url)', AGAINST_SQL, 4)} as score from q""")
def page_analysis(s, d):
    p = survey.analyzed(fx.shops(s, d))
    return p.select("page_id", "title", "kind", *[F.col(c).cast("double").alias(c) for c in ("total", "page_max", "visible", "listing_count")], "listing_like", F.round("score", 6).alias("score"))


@query("page_analysis_plain", rf"""with v as (select page_id, url, {VISIBLE} as t from pages) select page_id, len(t)::double as chars, {_hits_sql('lower(t)', FOR_SQL, 1)}::double as words, regexp_matches(t, '(?:19|20)\d{{2}}\s*년') as has_year from v""")
def page_analysis_plain(s, d):
    t = F.col("page.text")
    return html.with_page(table(s, d, "pages")).select("page_id", F.length(t).cast("double").alias("chars"), survey.hits(F.lower(t), survey.LISTING_WORDS).cast("double").alias("words"), t.rlike(survey.YEAR).alias("has_year"))


@query("page_analysis_given", f"""with v as (select page_id, url, {VISIBLE} as t, {TITLE} as title, regexp_matches(html, '(?i)(fetch\\s*\\(|axios\\.|XMLHttpRequest|\\$\\.ajax|/api/|graphql|_next/data|rest_route|wp-json|ajax)') as scripted, {PAGE_OF} as page_max from pages),
q as (select *, {_hits_sql("lower(concat(t, ' ', url))", FOR_SQL, 1)} >= 2 as listing_like from v)
select page_id, title, case when scripted then 'HTML+API호출 단서' else 'HTML 응답' end as kind, page_max::double as page_max, listing_like, (10 + case when listing_like then 25 else 0 end + case when scripted then 0 else 2 end + {_hits_sql('lower(url)', FOR_SQL, 3)} - {_hits_sql('lower(url)', AGAINST_SQL, 4)})::double as score from q""")
def page_analysis_given(s, d):
    return survey.analyzed(table(s, d, "pages")).select("page_id", "title", "kind", F.col("page_max").cast("double").alias("page_max"), "listing_like", F.col("score").cast("double").alias("score"))


#: The links of the given pages, in order; their labels hold no tags.
GIVEN_LINKS = f"""select page_id, pos, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), href) as url, href as path, {_characters('label')} as text from
(select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 as pos from pages)"""


@query("page_links_given", f"select page_id, pos::bigint as pos, url, path, text from ({GIVEN_LINKS})")
def page_links_given(s, d):
    return profile.links(html.with_page(table(s, d, "pages"))).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "path", "text")


@query("contract_given", f"""select page_id, regexp_replace(url, '[?#].*$', '') as base_endpoint, case when {QUERY} <> '' then array_to_string(list_sort(string_split({QUERY}, '&')), ' ') else '' end as current_query_params, 'HTML' as response_type, '' as observed from pages""")
def contract_given(s, d):
    c = profile.contract(html.with_page(table(s, d, "pages")))
    query_ = F.array_join(F.array_sort(F.transform(F.map_entries("current_query_params"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))), " ")
    return c.select("page_id", "base_endpoint", query_.alias("current_query_params"), "response_type", F.array_join("observed_param_names_ranked", " ").alias("observed"))


#: Pages whose elements lead on in several ways: the first of names that are equally frequent comes first.
MIXED = "concat('<form><input name=\"zz\"><input name=\"yy\"></form><a href=\"/p?b', page_id % 3, '=1&a=2\"> one </a><div onclick=\"window.location = ', chr(39), '/q?c=', page_id, chr(39), '\">two<a href=\"/p?a=3\" onclick=\"window.location.href=', chr(39), '/r?d=1', chr(39), '\">three</a></div><a href=\"\">none</a><a href=\"../../../../../../up/./x?b', page_id % 3, '=5\">up</a>')"


@query("element_order", """select page_id, string_agg(concat(path, '?', query, '#', text), ' ' order by pos) as links, concat('zz yy b', page_id % 3, ' a c d') as observed from
(select page_id, unnest([0, 1, 2, 3, 4]) as pos, unnest(['/p', '/q', '/p', '/r', '/up/x']) as path, unnest([concat('b', page_id % 3, '=1&a=2'), concat('c=', page_id), 'a=3', 'd=1', concat('b', page_id % 3, '=5')]) as query, unnest(['one', 'two three', 'three', 'three', 'up']) as text from pages) group by page_id""")
def element_order(s, d):
    pages = table(s, d, "pages").select("page_id", F.lit("http://h.example.com/1/2/3/").alias("url"), F.expr(MIXED).alias("html"))
    parsed = storage.stored(html.with_page(pages).drop("html"), "elements")
    shown = F.concat("path", F.lit("?"), urls.part(F.col("url"), 4), F.lit("#"), "text")
    rows = profile.links(parsed).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("x")))), lambda r: r["x"]), " ").alias("links"))  # five for each page
    return rows.join(profile.contract(parsed).select("page_id", F.array_join("observed_param_names_ranked", " ").alias("observed")), "page_id")


@query("request_contract", f"""select page_id, concat({SHOP_HOST}, '/list/index.php') as base_endpoint, concat('cate_code=', page_id % 3, ' page=', page_id % 5 + 1) as current_query_params,
concat('cate_code page stx bo_table', case when page_id % 2 = 0 then ' wr_id' else '' end) as observed_param_names_ranked, case when page_id % 3 = 0 then 'HTML 목록 + JS/Ajax 단서' else 'HTML' end as response_type,
'page' as likely_pagination_params, 'cate_code bo_table' as likely_category_params, 'stx' as likely_search_filter_params, case when page_id % 2 = 0 then 'wr_id' else '' end as likely_detail_id_params from pages""")
def request_contract(s, d):
    c = profile.contract(html.with_page(fx.shops(s, d)))
    query_ = F.array_join(F.array_sort(F.transform(F.map_entries("current_query_params"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))), " ")
    lists = [x for x in c.columns if x.startswith(("observed", "likely"))]
    return c.withColumns({"current_query_params": query_, **{x: F.array_join(x, " ") for x in lists}})


DETAIL_IDS = "case when page_id % 2 = 0 then 1 else 0 end"


#: The link to the top of the page has the parameters of the page itself.
@query("detail_links", f"select page_id, {DETAIL_IDS}::double as details, 3::double as pages_, 2::double as categories from pages")
def detail_links(s, d):
    rows = profile.links(html.with_page(fx.shops(s, d)))
    test = lambda t: F.count_if(t).cast("double")
    n = profile.names()
    return rows.groupBy("page_id").agg(test(profile.is_detail(n, F.col("path"))).alias("details"), test(profile.is_pagination(n)).alias("pages_"), test(profile.is_category(n)).alias("categories"))


# --- reports, detail records ---

ORIGIN_ROWS = "select o_orderkey as pos, concat('http://www.site', o_custkey % 40, '.example.com/l?x=', o_orderkey % 9) as url, concat('http://site', o_custkey % 40, '.example.com') as origin, o_orderkey % 997 as count, concat('http://site', o_custkey % 40, '.example.com/p', o_orderkey % 12) as page_url, case when o_orderkey % 5 = 0 then '' else concat('n', o_orderkey % 50) end as name, case when o_orderkey % 3 = 0 then 'nan' else concat('0', o_orderkey % 30) end as phone from orders"


def _first_sql(value: str, most: int) -> str:
    return f"select origin, string_agg(v, ' | ' order by n) as x from (select *, row_number() over (partition by origin order by c, p, v) as n from (select origin, {value} as v, first(-count order by -count, pos) as c, first(pos order by -count, pos) as p from r where {value} not in ('', 'nan') group by origin, {value})) where n <= {most} group by origin"


OVERVIEW = f"with r as ({ORIGIN_ROWS}), g as (select origin, max(count) as largest, count(*) as rows from r group by origin having max(count) > 100) select g.origin, largest, rows, coalesce(u.x, '') as urls, coalesce(n.x, '') as names, coalesce(f.x, '') as phones from g left join ({_first_sql('page_url', 5)}) u using (origin) left join ({_first_sql('name', 20)}) n using (origin) left join ({_first_sql('phone', 10)}) f using (origin)"


def _overview(s, d):
    o = table(s, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey") % 40
    rows = o.select(
        key.alias("pos"), F.concat(F.lit("http://www.site"), cust, F.lit(".example.com/l?x="), key % 9).alias("url"), (key % 997).alias("count"), F.concat(F.lit("http://site"), cust, F.lit(".example.com/p"), key % 12).alias("page_url"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("n"), key % 50)).alias("name"), F.when(key % 3 == 0, "nan").otherwise(F.concat(F.lit("0"), key % 30)).alias("phone"),
    )
    return origins.overview(origins.with_origin(rows, "url"))


query("origin_overview", OVERVIEW)(_overview)


@query("origin_documents", f"select origin, concat('slug', n % 3) as slug, concat(origin, '/list') as endpoint, concat('label ', n % 3) as label, largest from (select *, cast(regexp_extract(origin, 'site([0-9]+)', 1) as int) as n from ({OVERVIEW})) where n % 4 = 0 and n % 8 > 0")
def origin_documents(s, d):
    sites = s.range(40)
    origin = F.concat(F.lit("http://site"), "id", F.lit(".example.com")).alias("origin")
    endpoints = sites.where("id % 4 = 0").select(origin, F.concat(F.lit("slug"), F.col("id") % 3).alias("slug"), F.concat(origin, F.lit("/list")).alias("endpoint"))
    documents = s.range(3).select(F.concat(F.lit("slug"), "id").alias("slug"), F.concat(F.lit("label "), "id").alias("label"))
    meta = sites.where("id % 8 > 0").select(origin)
    return origins.with_meta(origins.with_documents(_overview(s, d), endpoints, documents), meta).select("origin", "slug", "endpoint", "label", "largest")


@query("origin_report", f"""select concat(replace(origin, 'http://', ''), '.md') as file, concat('# ', replace(origin, 'http://', ''), chr(10), chr(10), '{origins.OVERVIEW}', chr(10), chr(10), '- 사이트명: d', chr(10), '- Origin: `', origin, '`', chr(10), '- 사이트 내 매물 수: 약 `', format('{{:,}}', largest), '`건', chr(10), '- 확인한 대표 매물 URL: `', replace(urls, ' | ', '`, `'), '`', chr(10),
'- 취급장비 정보: e', chr(10), '- 대표자/운영자 정보: ', chr(10), case when names = '' then '' else concat('- 연결된 원본 업체: ', replace(names, ' | ', ', '), chr(10)) end, case when phones = '' then '' else concat('- 원본 CSV 대표전화: ', replace(phones, ' | ', ', '), chr(10)) end, chr(10), '{origins.API}', chr(10), chr(10), '{origins.NATURE}', chr(10), '- 단일 API 엔드포인트: `', origin, '/list`', chr(10), '{origins.METHOD}', chr(10),
'- 카테고리/게시판 파라미터: 미확인', chr(10), '- 페이지네이션 파라미터: `page`', chr(10), '- 검색/필터 파라미터: 미확인', chr(10), '- 상세 매물 식별자: `a`, `b`', chr(10), '- 기간 파라미터: p', chr(10), '- 예시 요청: `', origin, '/list', case when largest % 2 = 0 then '?q=a+%26b&q=2&page=1' else '' end, '`', chr(10), chr(10), '{origins.REMARKS}', chr(10), chr(10), case when largest % 3 = 0 then concat('- one', chr(10), '- two') else '- 예외 사항 없음.' end, chr(10)) as text from ({OVERVIEW})""".replace("{{", "{").replace("}}", "}"))
def origin_report(s, d):
    none = F.lit(None).cast("array<string>")
    params = {"likely_pagination_params": F.array(F.lit("page")), "likely_category_params": F.array().cast("array<string>"), "likely_search_filter_params": none, "likely_detail_id_params": F.array(F.lit("a"), F.lit("b"))}
    about = {"site_name": F.regexp_replace("origin", "^[a-z]+://", ""), "display_name": F.lit("d"), "equipment": F.lit("e"), "operator_note": F.lit(None).cast("string"), "period_note": F.lit("p"), "remarks": F.when(F.col("largest") % 3 == 0, F.array(F.lit("one"), F.lit("two")))}
    asked = F.when(F.col("largest") % 2 == 0, F.create_map(F.lit("q"), F.array(F.lit("a &b"), F.lit("2")), F.lit("page"), F.array(F.lit("1"))))
    return origins.report(_overview(s, d).withColumns({"endpoint": F.concat("origin", F.lit("/list")), "example_query": asked, **about, **params}))


@query("site_report", f"""select page_id, concat('## Categories', chr(10), chr(10), '- ', {SHOP_HOST}, '/bbs/board.php?bo_table=sale', chr(10), '- ', {SHOP_HOST}, '/list/index.php?page=', page_id % 5 + 1, '&cate_code=', page_id % 3, '#top', chr(10), chr(10), '## Links', chr(10), chr(10), '- ', {SHOP_HOST}, '/company/intro', chr(10), '- ', {SHOP_HOST}, '/bbs/board.php?bo_table=sale') as text from pages""")
def report_sections(s, d):
    rows = storage.kept(profile.links(html.with_page(fx.shops(s, d))))
    sections = [origins.numbered(rows.where(profile.is_category(profile.names())), "Categories", F.col("url"), [F.col("pos")], 10), origins.numbered(rows, "Links", F.col("url"), [F.col("pos")], 2)]
    return origins.site_report(sections[0].unionByName(sections[1]), ["Categories", "Links"])


#: The links of the made-up shop pages with their labels, joined with the page's URL.
SHOP_LINKS = f"""select page_id, pos, case when h like 'http%' then h when h like '#%' then concat(url, h) else concat({SHOP_HOST}, h) end as url, trim(regexp_replace(regexp_replace(label, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from
(select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1)) as h, unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1), 1) as pos from ({SHOPS})) where h not like 'javascript:%' and h not like 'http://other%'"""
_LIST = "string_agg(concat('- `', text, '` -> `', url, '`'), chr(10) order by r)"


@query("site_reports", f"""with l as materialized (select *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as q from ({SHOP_LINKS})),
n as (select page_id, pos, k, split_part(unnest(string_split(q, '&')), '=', 1) as name, k from (select *, 1 as k from l where q <> '')),
f as (select *, row_number() over (partition by page_id order by c desc, pos, name = 'cate_code') as r from (select page_id, name, count(*) as c, min(pos) as pos from n group by all)),
params as (select page_id, string_agg(concat('- `', name, '`: ', c), chr(10) order by r) as t from f group by page_id),
p as (select * from (select *, row_number() over (partition by page_id order by c desc, pos) as r from (select page_id, path, count(*) as c, min(pos) as pos from l group by all)) where r <= 10),
ps as (select page_id, path, string_agg(concat('  - `', text, '` -> `', url, '`'), chr(10) order by pos) as t from (select *, row_number() over (partition by page_id, path order by pos) as k from l) where k <= 3 group by all),
paths as (select p.page_id, string_agg(concat('- `', p.path, '`: ', c, ' links', chr(10), ps.t), chr(10) order by r) as t from p join ps using (page_id, path) group by p.page_id),
g as (select *, row_number() over (partition by page_id order by pos) as r from l where regexp_matches(q, '(^|&)page=')), c as (select *, row_number() over (partition by page_id order by pos) as r from l where regexp_matches(q, '(^|&)(bo_table|cate_code)=')),
pages_ as (select page_id, {_LIST} as t from g where r <= 10 group by page_id), cats as (select page_id, {_LIST} as t from c where r <= 12 group by page_id),
w as (select page_id, url, min(r) as r from (select page_id, url, r from g where r <= 3 union all select page_id, url, r + 3 from c where r <= 5) group by all),
tried as (select page_id, string_agg(concat('- `', case when k.url is null then '' else '200' end, '` `', case when k.url is null then '' else 'text/html' end, '` `', coalesce(k.bytes, ''), '` -> `', w.url, '`'), chr(10) order by r) as t from w left join (select url, max(strlen(html))::varchar as bytes from ({SHOPS}) where page_id % 2 = 0 group by url) k on k.url = w.url group by page_id),
s as (select *, page_id % 3 = 0 as hinted from ({SHOPS}))
select s.page_id, concat('# shop', page_id % 7, chr(10), chr(10), '- 확인 URL: `', url, '`', chr(10), '- 매물 수 추정: `', page_id, '`', chr(10), '- 응답 형식 판단: `', case when hinted then 'HTML 목록 + JS/Ajax 단서' else 'HTML' end, '`', chr(10), '- 기본 목록 엔드포인트: `', split_part(url, '?', 1), '`', chr(10),
'- 현재 Query: `{{"page": ["', page_id % 5 + 1, '"], "cate_code": ["', page_id % 3, '"]}}`', chr(10), chr(10), '## 요청 파라미터 요약', chr(10), chr(10), '- 카테고리/게시판: `cate_code, bo_table`', chr(10), '- 페이지네이션: `page`', chr(10), '- 검색/필터: `stx`', chr(10), '- 상세 ID: `', case when page_id % 2 = 0 then 'wr_id' else '미확인' end, '`',
chr(10), chr(10), '## 관찰된 파라미터 빈도', chr(10), chr(10), params.t, chr(10), chr(10), '## 폼 분석', chr(10), chr(10), '- Form 1: `POST` `', {SHOP_HOST}, '/search`', chr(10), '  - fields: `stx`, `cate_code`', chr(10), '  - text: 찾기 One Two', chr(10), chr(10), '## 주요 경로/샘플', chr(10), chr(10), paths.t,
chr(10), chr(10), '## 페이지네이션 샘플', chr(10), chr(10), pages_.t, chr(10), chr(10), '## 카테고리 샘플', chr(10), chr(10), cats.t, chr(10), chr(10), '## 스크립트/API 단서', chr(10), chr(10), '- 외부 스크립트 수: `1`', chr(10), '- 인라인 스크립트 수: `1`', chr(10), case when hinted then concat('- `', {SHOP_HOST}, '/api/list?x=1`', chr(10), '- `', {SHOP_HOST}, '/more`') else '- 명시적인 JSON/API 엔드포인트 미검출' end,
chr(10), chr(10), '## 검증 요청 샘플', chr(10), chr(10), tried.t, chr(10), chr(10), '## 크롤링 메모', chr(10), chr(10), '{chr(10).join(site_report.NOTES)}', chr(10)) as text,
(select count(distinct path) from l x where x.page_id = s.page_id)::int as paths, case when page_id % 2 = 0 then 1 else 0 end as details
from s join params using (page_id) join paths using (page_id) join pages_ using (page_id) join cats using (page_id) join tried using (page_id)""")
def site_reports(s, d):
    shops = fx.shops(s, d)
    pages = html.with_page(shops).withColumns({"name": F.concat(F.lit("shop"), F.col("page_id") % 7), "count_estimate": F.col("page_id")})
    captured = shops.where("page_id % 2 = 0").select("url", "html", F.lit("200").alias("status"), F.lit("text/html").alias("content_type"))
    out = site_report.reports(pages, hosts=[f"shop{i}.example.com" for i in range(7)], captured=captured)
    counted = lambda path: F.coalesce(F.size(F.from_json(F.get_json_object("document", path), "map<string,long>")), F.lit(0))
    return out.select("page_id", "text", F.size(F.from_json(F.get_json_object("document", "$.links.top_paths"), "array<struct<path:string>>")).alias("paths"), counted("$.links.detail_path_frequency").alias("details"))


@query("site_index", f"""with c as (select page_id, {SHOP_HOST} || '/list/index.php' as base, page_id % 3 = 0 as hinted, row_number() over (order by page_id % 97 desc, concat('s', page_id)) as rank from pages)
select rank, concat('|', rank, '|n', page_id, '|', page_id % 97, '|', case when hinted then 'HTML 목록 + JS/Ajax 단서' else 'HTML' end, '|`', base, '`|[s', page_id, '.md](s', page_id, '.md) / [s', page_id, '.json](s', page_id, '.json)|') as line from c""")
def site_index(s, d):
    c = profile.contract(html.with_page(fx.shops(s, d))).withColumns({"slug": F.concat(F.lit("s"), "page_id"), "name": F.concat(F.lit("n"), "page_id"), "count": F.col("page_id") % 97})
    return site_report.index_lines(c, "slug", "name", "count").select(F.col("rank").cast("long").alias("rank"), "line")


@query("detail_records", f"""with l as ({L}), d as (select *, case when id % 2 = 0 then concat('new ', id) else model_name end as m, case when id % 2 = 0 and id % 3 = 0 then concat_ws(' ', manufacturer, 'title') else listing_name end as t, case when id % 4 = 0 then coalesce(posted_at, timestamp '1998-07-01') else posted_at end as p from l where id % 5 in (1, 2) and id % 3 < 2)
select id, m as model_name, t as listing_name, strftime(p, '%Y-%m-%d %H:%M:%S') as posted_at, length(sha256('x')) as hash_chars from d where coalesce(p, posted_date) >= timestamp '1998-06-30' - interval 30 day""")
def detail_records(s, d):
    rows = fx.listings(s, d).withColumns({"pid": F.col("id").cast("string"), "metadata_json": F.when(F.col("id") % 5 == 0, "{broken").when(F.col("id") % 5 == 3, '{"pid":1}').when(F.col("id") % 5 == 4, '{"record":"{text"}').otherwise('{"record":{"pid":1},"x":2}')})
    even = F.col("id") % 2 == 0
    details = rows.where("id % 3 < 2").select(
        "pid", F.when(even, F.concat(F.lit("new "), "id")).otherwise("").alias("model_name"), F.when(even & (F.col("id") % 3 == 0), "title").alias("detail_title"),
        F.when(F.col("id") % 4 == 0, F.coalesce("posted_at", F.lit("1998-07-01").cast("timestamp_ntz"))).alias("posted_at"),
    )
    out = ls.detail_step(rows, details, "1m", F.lit("1998-06-30").cast("timestamp_ntz"))
    return out.select("id", "model_name", "listing_name", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), F.length("content_hash").cast("long").alias("hash_chars"))


@query("stored_rows", f"""with l as ({L}) select id, cast(coalesce(case when id % 3 = 0 then posted_date end, cast(posted_at as date)) as varchar) as posted_date, case when id % 2 = 0 then (id % 1000 + 1000)::double end as view_count, concat('{{"a":', id, '}}') as raw_json from l""")
def stored_rows(s, d):
    rows = fx.listings(s, d)
    given = F.when(F.col("id") % 3 == 0, F.col("posted_date").cast("string")).otherwise("bad")
    rows = rows.withColumns({"posted_date": given, "view_count": F.when(F.col("id") % 2 == 0, F.concat(F.lit("조회 1,"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"))).otherwise("-"), "raw": F.struct(F.col("id").alias("a"))})
    out = ls.stored_row(rows)
    return out.select(F.get_json_object("payload_json", "$.id").cast("long").alias("id"), F.col("posted_date").cast("string").alias("posted_date"), F.col("view_count").cast("double").alias("view_count"), "raw_json")


@query("json_excerpts", r"""with t as (select event_id, case event_id % 5 when 0 then '{|  "b": "한",|  "a": [|    ' || event_id || ',|    2|  ],|  "a__truncated_count": 4|}' when 1 then '{|  "s": [|    1|  ],|  "o": {|    "l": [|      "p",|      "q"|    ],|    "n": null|  }|}'
when 2 then '[|  1,|  {|    "k": [|      1,|      2,|      3|    ]|  }|]' end as t from events)
select event_id, case event_id % 5 when 3 then 'not json ' || event_id when 4 then '"' || repeat('x', 11999) || chr(10) || chr(10) || '... [truncated, original 13,002 chars]' else replace(t, '|', chr(10)) end as excerpt, case when event_id % 5 = 3 then 'text' else 'json' end as language from t""")
def json_excerpts(s, d):
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit('{"b":"한","a":['), "event_id", F.lit(",2,3,4]}"))).when(kind == 1, '{"s":[1],"o":{"l":["p","q","r"],"n":null}}').when(kind == 2, '[1,{"k":[1,2,3]},3]')
        .when(kind == 3, F.concat(F.lit("not json "), "event_id")).otherwise(F.concat(F.lit('"'), F.repeat(F.lit("x"), F.lit(13_000)), F.lit('"')))
    )
    found = tx.json_excerpt(text)
    return table(s, d, "events").select("event_id", found.alias("x")).select("event_id", F.col("x.text").alias("excerpt"), F.col("x.language").alias("language"))


@query("chunk_names", "select n_nationkey, concat('site/chunks/20260501_', n_nationkey, '_A_b.json') as name, 'db' as database, case when n_nationkey % 2 = 0 then 'h' end as host from nation")
def chunk_names(s, d):
    config = F.when(F.col("n_nationkey") % 2 == 0, '{"mysql":{"database":"db","host":"h","password":"p"}}').otherwise('{"database":"db","user":"u"}')
    name = tx.chunk_name(F.lit("site"), F.lit("20260501"), F.concat("n_nationkey", F.lit(" A/b ")))
    return table(s, d, "nation").select("n_nationkey", name.alias("name"), tx.public_config(config)["database"].alias("database"), tx.public_config(config)["host"].alias("host"))


@query("page_kind", r"select page_id, case when page_id % 5 = 0 then 'API(JSON 응답)' when regexp_matches(html, '(?i)(fetch\s*\(|axios\.|XMLHttpRequest|\$\.ajax|/api/|graphql|_next/data|rest_route|wp-json|ajax)') then 'HTML+API호출 단서' else 'HTML 응답' end as kind, case when page_id % 5 = 0 then 'json' else 'html' end as extension from pages")
def page_kind(s, d):
    kind = F.when(F.col("page_id") % 5 == 0, "application/JSON").otherwise("text/html; charset=utf-8")
    return table(s, d, "pages").select("page_id", survey.response_kind(F.lit(True), F.lit("200"), kind, F.col("html")).alias("kind"), tx.extension(kind).alias("extension"))


@query("json_lookup", "select event_id, (props ->> '$.k')::int as k from events where (props ->> '$.k')::int >= 50")
def json_lookup(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k >= 50")


@query("display_texts", f"""with l as ({L}) select id, case when price_krw > 0 then concat(format('{{:,}}', price_krw), '') else price end as price_text, case status when 'O' then 'O' when 'F' then '완료' else '실행중' end as state,
coalesce(strftime(posted_at, '%Y-%m-%d %H:%M:%S'), '-') as posted, case when id % 3 = 0 then '-' else concat(format('{{:,}}', id % 3 * 1200), '시간') end as hours, epoch_ms(crawled_at)::double as crawled_ms from l""".replace("{{", "{").replace("}}", "}"))
def display_texts(s, d):
    state = F.when(F.col("status") == "F", "done").when(F.col("status") == "P", "running").otherwise(F.col("status"))
    return fx.listings(s, d).select("id", tx.format_price(F.col("price_krw"), F.col("price")).alias("price_text"), tx.status_label(state).alias("state"), tx.format_datetime(F.col("posted_at")).alias("posted"), tx.format_hours(F.col("id") % 3 * 1200).alias("hours"), tx.epoch_millis(F.col("crawled_at")).cast("double").alias("crawled_ms"))


@query("task_category", f"with t as ({T}) select id, case when id % 2 = 0 then concat('k', id % 5) when id % 3 = 0 then 'meta' else '' end as category_code, category_name from t")
def task_category(s, d):
    meta = F.when(F.col("id") % 3 == 0, F.lit('{"category_code":"meta","category_name":"no"}')).when(F.col("id") % 3 == 1, F.lit("{broken"))
    rows = fx.tasks(s, d).withColumns({"metadata_json": meta, "category_code": F.when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 5))})
    return tk.with_category(rows).select("id", "category_code", "category_name")


@query("pages_to_sample", f"""with p as (select page_id, {HOST} as host, url, row_number() over (partition by {HOST} order by page_id) as r from pages where {QUERY} like '%page=%'), f as (select host, url, min(r) as rank from p where r <= 3 group by all) select host, url, rank from f""")
def pages_to_sample(s, d):
    return profile.pages_to_sample(profile.with_params(table(s, d, "pages")), "host", ["page_id"]).select("host", "url", F.col("rank").cast("long").alias("rank"))


@query("detail_urls", "select page_id, case when page_id % 2 = 0 then concat('http://h.example.com/v.html?pid=', page_id) else concat('http://h.example.com/x/d.html?id=', page_id) end as detail_url, concat('http://h.example.com/l.html?cate_code=10', page_id % 3, '&limit=70&page=', page_id) as list_url from pages")
def detail_urls(s, d):
    href = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("d.html?a=1&pid="), "page_id")).otherwise(F.concat(F.lit("d.html?id="), "page_id"))
    compact = urls.compact_detail_url(F.lit("http://h.example.com/x/list.html"), href, F.lit("http://h.example.com/v.html"))
    return table(s, d, "pages").select("page_id", compact.alias("detail_url"), urls.list_url("http://h.example.com/l.html", F.concat(F.lit("10"), F.col("page_id") % 3), F.col("page_id")).alias("list_url"))


# --- boards: list and detail pages ---


@query("board_rows", "select page_id, concat('http://h', page_id % 5, '.example.com/list.html') as crawl_url, concat('http://h', page_id % 5, '.example.com/sub8_1_vvv.html?pid=', page_id) as detail_url, cast(page_id as varchar) as pid, concat('현대 R', page_id) as listing_name, '8,500만원' as price, concat('2026-05-', lpad(cast(page_id % 28 + 1 as varchar), 2, '0')) as posted_date, '1,234' as view_count, '판매' as trade_type, 13::double as cells from pages")
def board_rows(s, d):
    rows = board.listing_rows(html.with_page(fx.boards(s, d)), F.lit("2026-06-01").cast("timestamp_ntz"))
    return rows.select("page_id", "crawl_url", "detail_url", "pid", "listing_name", "price", F.col("posted_date").cast("string").alias("posted_date"), "view_count", F.col("raw.trade_type").alias("trade_type"), F.size("raw.list_values").cast("double").alias("cells"))


@query("board_details", "select page_id, concat('Nice ', page_id) as detail_title, concat('2026-04-', lpad(cast(page_id % 28 + 1 as varchar), 2, '0')) as posted_date, concat('M', page_id) as model_name, concat(page_id % 90 + 1, ',000만원') as price, concat('Line 1 Line ', page_id) as description, 2::double as labels, page_id % 3 = 2 as has_next from pages")
def board_details(s, d):
    pages = storage.stored(html.with_page(fx.boards(s, d)).drop("html"), "boards")  # parsed once for both
    details = board.details(pages, F.lit("2026-06-01").cast("timestamp_ntz"))
    nexts = board.expected_next(pages, F.lit(2)).select("page_id", "has_next")
    return details.join(nexts, "page_id").select("page_id", "detail_title", F.col("posted_date").cast("string").alias("posted_date"), "model_name", "price", "description", F.size("raw_detail").cast("double").alias("labels"), "has_next")


@query("board_categories", "select page_id, concat('10', lpad(cast(page_id % 50 as varchar), 4, '0')) as code, concat('굴삭기 ', page_id) as name from pages")
def board_categories(s, d):
    return board.categories(html.with_page(fx.boards(s, d))).select("page_id", "code", "name")


# --- sources and sinks: written to the shared folder and read back ---


@query("csv_round_trip", """select n_nationkey::varchar as n_nationkey, n_name || ', "x"' as n_name, n_regionkey::varchar as n_regionkey from nation""")
def csv_round_trip(s, d):
    path = storage.new_path(s, "csv")
    sinks.write_csv(table(s, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n_name"), "n_regionkey"), path)
    return sources.csv_text(s, path)


@query("csv_typed", "select r_regionkey::int as r_regionkey, r_name, (r_regionkey * 1.5)::double as half from region")
def csv_typed(s, d):
    path = storage.new_path(s, "csv")
    sinks.write_csv(table(s, d, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") * F.lit(1.5).cast("double")).alias("half")), path, bom=False)
    return sources.csv_typed(s, path, "r_regionkey int, r_name string, half double")


@query("json_round_trip", "select r_regionkey::bigint as id, r_name as name, 'part-' as slug from region")
def json_round_trip(s, d):
    path = storage.new_path(s, "json")
    sinks.write_json(table(s, d, "region").select(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).alias("doc")), path)
    docs = s.read.schema("doc struct<id:long,name:string>").json(path)
    one = storage.new_path(s, "doc")
    sinks.write_text(s, '{"page":\n {"status": 200}}', one)
    status = sources.json_documents(s, one, "page struct<status:int>").where("page.status = 200").select(F.substr("slug", F.lit(1), F.lit(5)).alias("slug"))
    return docs.select("doc.*").join(F.broadcast(status))  # one row


#: The title of each page as bytes of a character set, with the set's name given, wrong or not given at all.
BODIES = "case page_id % 3 when 0 then encode(t, 'utf-8') when 1 then encode(t, 'iso-8859-1') else encode(concat(t, 'é'), 'iso-8859-1') end"


@query("bodies", f"""select page_id, case when page_id % 3 = 2 then concat(t, 'é') else t end as body from (select page_id, regexp_replace({TITLE}, '[^ -~]', '', 'g') as t from pages)""")
def bodies(s, d):
    titles = html.with_page(table(s, d, "pages")).select("page_id", F.regexp_replace(html.title(F.col("page")), "[^ -~]", "").alias("t"))
    rows = titles.select("page_id", F.expr(BODIES).alias("content"), F.when(F.col("page_id") % 3 == 1, "no-such-set").when(F.col("page_id") % 3 == 2, "latin-1").alias("charset"))
    return rows.select("page_id", html.decode_body("content", "charset").alias("body"))


@query("dictionary_line", f"""with k as (select regexp_replace(upper(concat(p_type, ' ', p_partkey % 40)), '[^0-9A-Z가-힣]', '', 'g') as key, concat(p_type, ' ', p_partkey % 40) as value, row_number() over (order by p_partkey) - 1 as pos from part) select min(pos)::int as pos, key, arg_max(value, pos) as value from k group by key""")
def dictionary_line(s, d):
    names_ = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(" ", "p_type", (F.col("p_partkey") % 40).cast("string")).alias("v")))), lambda x: x["v"])
    path = storage.new_path(s, "dictionary")
    # The file has one line by its format: all names of the dictionary.
    table(s, d, "part").agg(F.concat(F.lit("\ufeff"), F.array_join(names_, ","), F.lit(",\nnot,read")).alias("value")).write.text(path)
    entries = dictionary.from_values(sources.dictionary_line(s, path))
    return entries.select(F.col("ord").cast("int").alias("pos"), "key", F.col("canonical").alias("value"))


@query("skip_log", """select n_nationkey::bigint as n_nationkey, concat('http://***:***@h/', n_name) as url, concat('{"method":"GET","url":"http://***:***@h/","status":', n_nationkey, '}') as context from nation union all select n_nationkey::bigint, 'again', '{"status":1}' from nation""")
def skip_log(s, d):
    path = storage.new_path(s, "log")
    n = table(s, d, "nation")
    secret, none = F.lit("http://user:pass@h/"), F.lit(None).cast("string")
    sinks.append_log(n.select("n_nationkey", F.concat(secret, "n_name").alias("url"), sinks.error_context(F.lit("GET"), secret, F.col("n_nationkey"), F.lit("")).alias("context")), path)
    sinks.append_log(n.select("n_nationkey", F.lit("again").alias("url"), sinks.error_context(F.lit(""), none, F.lit(1), F.lit("")).alias("context")), path)
    return s.read.schema("n_nationkey long, url string, context string").json(path)


@query("captures", "select concat('s', page_id % 3) as slug, page_id, case when page_id % 2 = 0 then 'json' else 'html' end as response_extension, length(html) > 12000 as cut, false as sensitive_values_stored from pages")
def captures(s, d):
    path = storage.new_path(s, "capture")
    kind = F.when(F.col("page_id") % 2 == 0, "application/json").otherwise("text/html")
    sinks.capture(table(s, d, "pages").select(F.concat(F.lit("s"), F.col("page_id") % 3).alias("slug"), "page_id", kind.alias("content_type"), F.col("html").alias("body")), path)
    return s.read.parquet(path).select("slug", "page_id", "response_extension", F.col("excerpt").contains("[truncated, original").alias("cut"), "sensitive_values_stored")


@query("chunk_files", """with r as (select n_regionkey, n_nationkey, n_name, (row_number() over (partition by n_regionkey order by n_nationkey) - 1) // 3 as chunk from nation)
select concat('green/chunks/2026_region_', n_regionkey, '-', chunk, '.json') as file, concat('[', chr(10), string_agg(concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}'), concat(',', chr(10)) order by n_nationkey), chr(10), ']', chr(10)) as content from r group by n_regionkey, chunk""")
def chunk_files(s, d):
    path = storage.new_path(s, "chunks").removeprefix("file:")
    n = table(s, d, "nation")
    files.write_chunks(n.select("n_nationkey", "n_name", "n_regionkey"), path, "green", F.lit("2026"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), ["n_nationkey"], 3)
    return files.read_named(s, path).select("file", F.col("content").cast("string").alias("content"))


@query("capture_folders", """select concat('p', page_id, '/', f) as file, sha256(case f when 'request.curl' then concat('curl -L ', chr(92), chr(10), '  ', chr(39), url, chr(39), ' ', chr(92), chr(10), '  -H ', chr(39), 'A: b', chr(39), chr(10)) when 'response_headers.txt' then concat('HTTP status: 200', chr(10), 'Content-Type: text/html', chr(10)) when 'response_body.html' then html
else concat('{"slug":"p', page_id, '","method":"GET","request_url":"', url, '","status":200,"content_type":"text/html","body_length":', strlen(html), ',"response_body_file":"response_body.html","page_id":', page_id, ',"sensitive_values_stored":false}', chr(10)) end) as content from pages, (values ('request.curl'), ('response_headers.txt'), ('response_body.html'), ('metadata.json')) v(f)""")
def capture_folders(s, d):
    path = storage.new_path(s, "captures").removeprefix("file:")
    requests = table(s, d, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("slug"), F.lit("get").alias("method"), "url", F.array(F.lit("A: b")).alias("headers"), F.lit(None).cast("string").alias("request_body"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("response_headers"), F.col("html").alias("body"), "page_id",
    )
    captured = files.capture_files(requests)
    files.write_named(captured, path)
    return files.read_listed(captured, path).select("file", F.sha2("content", 256).alias("content"))


@query("curl_commands", """select n_nationkey, concat('curl -L', case when n_nationkey % 3 > 0 then concat(' ', chr(92), chr(10), '  -X POST') else '' end, ' ', chr(92), chr(10), '  ', chr(39), 'http://h/?q=', n_name, chr(39), ' ', chr(92), chr(10), '  -H ', chr(39), 'A: b', chr(39), ' ', chr(92), chr(10), '  -b ', chr(39), 'sid=<cookie>', chr(39),
case when n_nationkey % 2 = 0 then concat(' ', chr(92), chr(10), '  --data "x=', chr(39), '"') when n_nationkey % 5 = 0 then concat(' ', chr(92), chr(10), '  --data ', chr(39), '{"k": "', chr(92), chr(39), '"}', chr(39)) else '' end) as command from nation""")
def curl_commands(s, d):
    key = F.col("n_nationkey")
    body = F.when(key % 2 == 0, "x='").when(key % 5 == 0, '{"k": "\'"}')
    command = sinks.curl(F.when(key % 3 > 0, "post").otherwise("GET"), F.concat(F.lit("http://h/?q="), "n_name"), F.array(F.lit("A: b"), F.lit("Cookie: sid=<cookie>")), body)
    return table(s, d, "nation").select("n_nationkey", command.alias("command"))


@query("request_options", """select event_id, case when event_id % 4 = 0 then 1000 else least(5000, greatest(1, floor(value * 100)::int)) end as plain, (event_id % 2 + case when event_type <> '' then 1 else 0 end)::int as active from events""")
def request_options(s, d):
    e = table(s, d, "events")
    asked = F.when(F.col("event_id") % 4 > 0, F.floor(F.col("value") * 100).cast("string"))
    active = ls.active_filters(F.col("event_type"), F.lit(" "), F.when(F.col("event_id") % 2 == 1, "5"))
    return e.select("event_id", ls.clamped(asked).alias("plain"), active.alias("active"))


@query("known_sites", "select page_id, case when page_id % 3 < 2 then 'green_heavy' end as slug from pages")
def known_sites(s, d):
    key = F.col("page_id")
    wanted = F.when(key % 3 == 0, "https://www.4396200.com/").when(key % 3 == 1, "green_heavy").otherwise(urls.host_key(F.col("url")))
    return table(s, d, "pages").select("page_id", sources.site_slug(wanted).alias("slug"))


@query("table_or_empty", "select n_regionkey as region, count(*) as tasks, 0 as missing from nation group by all")
def table_or_empty(s, d):
    name = f"shale_{storage.new_path(s, 'view').rsplit('-', 1)[1]}"
    table(s, d, "nation").createOrReplaceTempView(name)
    found = sources.tasks_or_empty(s, name).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("tasks"))
    missing = sources.tasks_or_empty(s, f"{name}_none").agg(F.count("*").cast("int").alias("missing"))
    return found.join(F.broadcast(missing))  # one row


@query("names_and_modes", "select n_nationkey, concat(n_name, '_a.b') as safe, sha256(concat('u', n_nationkey)) as hash, case when n_nationkey % 2 = 0 then (1000 + n_nationkey)::double end as number, concat('`', n_name, '`, `b`') as params, case when n_nationkey % 3 = 0 then '' when n_nationkey % 3 = 1 then 'https://www.a.com' else 'http://a.com;b' end as url, '1m' as mode from nation")
def names_and_modes(s, d):
    key = F.col("n_nationkey")
    return table(s, d, "nation").select(
        "n_nationkey", tx.safe_name(F.concat(F.lit("/"), F.replace("n_name", F.lit(" "), F.lit(" ")), F.lit(" ?a.b**"))).alias("safe"), urls.url_hash(F.concat(F.lit("u"), key)).alias("hash"),
        tx.nullable_int(F.when(key % 2 == 0, F.concat(F.lit("no 1,"), F.lpad(key.cast("string"), 3, "0"))).otherwise("none")).cast("double").alias("number"), tx.param_list(F.array("n_name", F.lit("b"))).alias("params"),
        urls.normalize_url(F.when(key % 3 == 0, " ").when(key % 3 == 1, " www.a.com").otherwise("a.com；b")).alias("url"), F.lit(tx.normalize_mode("최근1달")).alias("mode"),
    )


@query("truncated_texts", "select page_id, case when length(html) > 50 then concat(substring(html, 1, 50), chr(10), chr(10), '... [truncated, original ', format('{:,}', length(html)), ' chars]') else html end as text from pages")
def truncated_texts(s, d):
    return table(s, d, "pages").select("page_id", tx.truncated(F.col("html"), 50).alias("text"))


@query("enriched_records", f"with l as ({L}) select id, case when id % 4 = 0 then 'given' when id % 2 = 0 then 'ALPHA' when id % 3 = 0 then 'BETA' end as model_norm, case when id % 7 > 0 then replace(price, '만원', '')::double * 10000 end as price_krw from l")
def enriched_records(s, d):
    rows = fx.listings(s, d).select("id", "price", F.when(F.col("id") % 2 == 0, "x alpha-9").otherwise("zz").alias("model_name"), F.when(F.col("id") % 3 == 0, "Beta").otherwise("yy").alias("listing_name"), F.when(F.col("id") % 4 == 0, "given").alias("model_norm"))
    entries = dictionary.from_values(s.createDataFrame([(0, "ALPHA"), (1, "BETA")], "pos int, value string"))
    return ls.enriched(rows, entries).select("id", "model_norm", F.col("price_krw").cast("double").alias("price_krw"))


@query("windowed_events", "select strftime(time_bucket(interval 5 minutes, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as count from events group by all")
def windowed_events(s, d):
    return streaming.windowed_counts(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "count")


def _event_stream(s, d):
    """events as a stream of their file, or of the files of their folder."""
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))  # as a pattern, the path may be a file


@query("sliding_windows", """with w as (select event_type, unnest([time_bucket(interval 5 minutes, ts), time_bucket(interval 5 minutes, ts) - interval 5 minutes]) as start from events)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as count from w group by all""")
def sliding_windows(s, d):
    rows = streaming.finished(streaming.windowed_counts(_event_stream(s, d), "ts", "event_type", window="10 minutes", slide="5 minutes"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "count")


@query("session_windows", """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as new from events),
i as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as island from g)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as end, user_id, count(*) as count from i group by user_id, island""")
def session_windows(s, d):
    rows = streaming.finished(streaming.session_counts(_event_stream(s, d), "ts", "user_id"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select(shown("start"), shown("end"), "user_id", "count")


@query("run_summary", f"with l as ({L}), t as ({T}) select (select count(*) from l) as records, (select count(price_krw) from l) as priced, (select string_agg(concat(status, '=', n), ',' order by status) from (select status, count(*) as n from t group by status)) as queue")
def run_summary(s, d):
    queue = F.array_join(F.array_sort(F.transform(F.map_entries("queue"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return tk.run_summary(fx.listings(s, d), fx.tasks(s, d)).select("records", "priced", queue.alias("queue"))


@query("hosts_listed", f"select {SHOP_HOST} as shop, 14 * count(*) as links from pages group by 1")
def hosts_listed(s, d):
    rows = profile.on_hosts(profile.links(html.with_page(fx.shops(s, d))), [f"www.shop{i}.example.com" for i in range(7)])
    rows = rows.where(~F.col("url").contains("wr_id"))
    return rows.groupBy(F.concat(F.lit("http://www."), "host").alias("shop")).agg(F.count("*").alias("links"))


@query("survey_rows", """with p as (select page_id, page_id % 10 = 9 as off, case when page_id % 10 = 9 then 0 when page_id % 4 = 0 then page_id % 900 else 2 * greatest(2, page_id % 5 + 1) end as n from pages)
select page_id as seed_no, concat('n', page_id) as name, concat('shop', page_id % 7, '.example.com') as domain, n::double as listing_count, case when off then 'N' when n = 0 then '추정' else 'Y' end as flag, 'a || b' as attempted,
concat('query_params=page=', page_id % 5 + 1, '&cate_code=', page_id % 3, ' | page | ', case when page_id % 3 = 0 and off then '스크립트/API 엔드포인트 확인 필요' else 'requests+BeautifulSoup 가능' end) as crawl_fields from p""")
def survey_rows(s, d):
    best = survey.analyzed(fx.shops(s, d)).withColumnsRenamed({"page_id": "seed_no"}).withColumn("attempted", F.array(F.lit("a"), F.lit("b"))).drop("page", "html", "text")
    seeds = table(s, d, "pages").select(F.col("page_id").alias("seed_no"), F.concat(F.lit("n"), "page_id").alias("name"))
    out = survey.survey_rows(seeds, best, F.lit("2026-05-01"))
    return out.select("seed_no", "name", "domain", F.col("listing_count").cast("double").alias("listing_count"), "flag", "attempted", "crawl_fields")


KEY = f"concat('//', {BARE}, coalesce(nullif({PATH}, ''), '/'), case when {QUERY} <> '' then concat('?', {QUERY}) else '' end)"
#: The pages that a survey looks at: its seeds, and the seven best links of each, twelve in all.
FRONTIER = f"""c as (select *, {KEY} as key from ({fx.duck(fx.DEALERS_SQL)})), s as (select *, {KEY} as key, row_number() over (partition by seed_no order by pos) as place from ({fx.duck(fx.SEEDS_SQL)})),
l as (select s.seed_no, s.place, concat('http://', regexp_extract(c.url, '//([^/]*)', 1)) as origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) as pos from s join c using (key) where s.place < 12),
m as (select seed_no, place, pos, concat(origin, href) as url, {_hits_sql("lower(concat(label, ' ', href))", FOR_SQL, 4)} - {_hits_sql("lower(concat(label, ' ', href))", AGAINST_SQL, 3)} + case when label = '' then -2 else 0 end + case when regexp_matches(href, '(?i)(page|list|product|goods|sell|sale|sub[0-9]+|m[0-9]+)') then 2 else 0 end as score from l),
b as (select * from (select *, row_number() over (partition by seed_no, place order by score desc, pos) as rank from (select * from m where score > 0 qualify row_number() over (partition by seed_no, place, url order by pos) = 1)) where rank <= 7),
q as (select seed_no, 0 as round, place as parent, 0 as rank, url from s union all select seed_no, 1, place, rank, url from b),
f as (select * from (select *, row_number() over (partition by seed_no order by round, parent, rank) as place from (select * from q qualify row_number() over (partition by seed_no, url order by round, parent, rank) = 1)) where place <= 12 or round = 0)"""


@query("survey_frontier", f"with {FRONTIER} select seed_no, place, url as requested from f")
def survey_frontier(s, d):
    return survey.frontier(fx.seeds(s, d), fx.dealers(s, d))


@query("survey_best", f"""with {FRONTIER}, a as (select f.seed_no, f.place, f.url as requested, {KEY.replace('url', 'f.url')} as key from f),
p as (select a.seed_no, a.place, a.requested, c.*, c.html is not null as there from a left join c on a.key = c.key),
g as (select seed_no, place, requested, there, coalesce(url, requested) as url, coalesce(ok, false) as ok, coalesce(status, '') as status, coalesce(html, '') as html from p),
h as (select *, regexp_extract(html, '<title>(.*?)</title>', 1) as title, contains(html, '고객센터') as off, try_cast(regexp_extract(html, '총 게시물 ([0-9]+) 건', 1) as int) as total, len(list_distinct(regexp_extract_all(html, '<a href="(/item/[0-9]+)">굴삭기', 1))) as seen from g),
n as (select *, case when off then 0 else coalesce(total, seen) end as listing_count, not off and (there or {_hits_sql("lower(concat(' ', url))", FOR_SQL, 1)} >= 2) as listing_like from h),
r as (select *, case when ok then 10 else 0 end + case when listing_like then 25 else 0 end + least(listing_count, 200) / 10.0 + case when ok then 2 else 0 end + {_hits_sql('lower(url)', FOR_SQL, 3)} - {_hits_sql('lower(url)', AGAINST_SQL, 4)} as score from n),
t as (select seed_no, string_agg(concat(requested, ' [', case when status = '' then 'not captured' else status end, ']'), ' || ' order by place) as attempted from r where place <= 16 group by seed_no)
select seed_no, place, url, title, listing_count::double as listing_count, listing_like, round(score, 6) as score, attempted from r join t using (seed_no) qualify row_number() over (partition by seed_no order by score desc, place) = 1""")
def survey_best(s, d):
    best = survey.surveyed(fx.seeds(s, d), fx.dealers(s, d))
    return best.select("seed_no", "place", "url", "title", F.col("listing_count").cast("double").alias("listing_count"), "listing_like", F.round("score", 6).alias("score"), F.array_join("attempted", " || ").alias("attempted"))


@query("origin_order", f"with o as ({OVERVIEW}) select origin, largest, row_number() over (order by largest desc, origin) as rank from o")
def origin_order(s, d):
    return storage.ranked(_overview(s, d).select("origin", "largest"), [F.desc("largest"), F.asc("origin")]).withColumn("rank", F.col("rank").cast("long"))


@query("capped_records", f"with l as ({L}) select id, 'capped' as kind from (select id from l order by id desc limit 7) union all select id, 'all' from l")
def capped_records(s, d):
    rows = fx.listings(s, d).select("id")
    return ls.capped(rows, 7, F.desc("id")).withColumn("kind", F.lit("capped")).unionByName(ls.capped(rows, 0).withColumn("kind", F.lit("all")))


@query("display_metrics", f"with l as ({L}) select format('{{:,}}', count(*)) as total, format('{{:,}}', count(price_krw)) as priced, cast(max(posted_date) as varchar) as latest from l union all select '0', '0', '-'")
def display_metrics(s, d):
    rows = fx.listings(s, d)
    return ls.display_stats(ls.stats(rows)).unionByName(ls.display_stats(ls.stats(rows.where("id < 0"))))
