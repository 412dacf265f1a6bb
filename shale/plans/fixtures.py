"""The general tables seen as listings, crawl tasks and transitions. The SQL is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.sources import table

LISTINGS_SQL = """
select o_orderkey as id, concat(c_mktsegment, ' ', o_orderpriority) as listing_name, concat('m', cast(o_custkey % 50 as string)) as model_name,
  case when o_custkey % 3 = 0 then concat('M', cast(o_custkey % 50 as string)) end as model_norm,
  case when o_orderkey % 4 = 0 then concat('used ', cast(90 + o_orderkey % 9000 as string), ' hours') else '' end as description,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 13 = 0 then 0 else cast(floor(o_totalprice) as bigint) end as price_krw,
  case when o_orderkey % 7 = 0 then '가격협의' else concat(cast(cast(floor(o_totalprice / 10000) as bigint) as string), '만원') end as price,
  case when o_custkey % 5 = 0 then '' when o_custkey % 5 = 1 then concat('+82 10-', lpad(cast(o_custkey % 17 as string), 4, '0'), '-', lpad(cast(o_custkey % 13 as string), 4, '0'))
    else concat('TEL 010-', lpad(cast(o_custkey % 17 as string), 4, '0'), '-', lpad(cast(o_custkey % 13 as string), 4, '0'), ' / 02-555-', lpad(cast(o_custkey % 7 as string), 4, '0')) end as contact,
  case when o_orderkey % 11 = 0 then null else o_orderdate end as posted_at, case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end as posted_date,
  o_orderdate as crawled_at, c_mktsegment as manufacturer, o_orderstatus as status, c_name as seller, concat('region ', cast(c_nationkey as string)) as location,
  case o_orderkey % 4 when 0 then concat(cast(1990 + o_orderkey % 33 as string), '년 ', cast(1 + o_orderkey % 14 as string), '월') when 1 then cast(1990 + o_orderkey % 33 as string)
    when 2 then 'n/a' else concat(cast(1990 + o_orderkey % 33 as string), '-', lpad(cast(1 + o_orderkey % 12 as string), 2, '0')) end as manufactured_ym,
  case o_custkey % 4 when 0 then 'Mascus Korea' when 1 then '그린중기' when 2 then '' else 'other source of names' end as source_site,
  case when o_custkey % 9 = 0 then '' else concat('http://www.site', cast(o_custkey % 6 as string), '.example.com/') end as origin,
  concat('http://crawl.example.com/list?page=', cast(o_orderkey % 10 as string)) as crawl_url,
  case when o_orderkey % 3 = 0 then '' else concat('http://detail.example.com/', cast(o_orderkey as string)) end as detail_url, concat('c', cast(o_orderkey % 6 as string)) as category_name,
  case when o_orderkey % 6 = 0 then concat(chr(123), '"detail":', chr(123), '"memo":"', cast(100 + o_orderkey % 50 as string), ' h","가동시간":"', cast(500 + o_orderkey % 700 as string), ' hr"', chr(125), chr(125)) when o_orderkey % 6 = 1 then concat(chr(123), 'broken 345 hrs') end as raw_json
from {orders} join {customer} on o_custkey = c_custkey"""

TASKS_SQL = """
select o_orderkey as id, case o_custkey % 4 when 0 then 'green_heavy' when 1 then 'mascus_korea' when 2 then 'other_site' else '' end as site_slug, 'http://o.example.com' as origin,
  case o_orderstatus when 'O' then 'pending' when 'F' then 'done' when 'P' then case when o_orderkey % 10 = 0 then 'odd' else 'running' end end as status,
  case when o_orderkey % 2 = 0 then 'detail' else 'list' end as task_type, case when o_orderkey % 2 = 0 then 5 else 10 end as priority,
  concat('http://t.example.com/', cast(o_orderkey as string)) as url, concat('c', cast(o_orderkey % 6 as string)) as category_name, case when o_orderkey % 8 = 0 then 'timeout' end as last_error,
  case when o_orderkey % 3 = 0 then null else o_orderdate end as next_run_at, case when o_orderstatus = 'F' and o_orderkey % 5 > 0 then o_orderdate end as success_at,
  case when o_orderkey % 5 = 1 then null else o_orderdate end as updated_at, o_orderdate as created_at
from {orders}"""

#: Events as transitions of a task for each user; 'kind' by the type of event.
TRANSITIONS_SQL = """
select user_id, event_id as seq, ts as at, case event_type when 'click' then 'start' when 'view' then 'done' when 'error' then 'retry' when 'signup' then 'enqueue'
  else case when event_id % 3 = 0 then 'recover' else 'enqueue_reset' end end as kind,
  case when event_id % 2 = 0 then 400 else 503 end as code, concat('e', cast(event_id as string)) as error, case when event_id % 2 = 0 then 900 else 60 end as wait
from {events}"""


#: Listing pages made from the numbers of pages: links, a form, scripts, totals. The SQL is valid in Spark and in DuckDB.
SHOPS_SQL = """
select page_id, concat('http://www.shop', page_id % 7, '.example.com/list/index.php?page=', page_id % 5 + 1, '&cate_code=', page_id % 3) as url,
  concat('<html><head><title> ', case when page_id % 10 = 9 then '고객센터' else '굴삭기  매매' end, ' ', page_id, '</title><script src="/a.js"></script></head><body>',
    case when page_id % 4 = 0 then concat('<p>총 게시물 ', page_id % 900, ' 건</p>') else '<p>목록</p>' end,
    '<a href="/company/intro">회사소개</a><a href="/bbs/board.php?bo_table=sale">매물 게시판</a><a href="/goods?page=2#top">next</a><a href="/goods?page=2"> 중고 <b>장비</b></a>',
    '<a href="http://other.example.org/goods">goods</a><a href="javascript:x()">매물</a><a href="#top">매물</a>',
    case when page_id % 2 = 0 then concat('<a href="/view?wr_id=', page_id, '"></a>') else '' end,
    '<a href="/sub6/1">sub6</a><a href="/sub6/2">sub6</a><a href="/sub6/3">sub6</a><a href="/sub6/4">sub6</a><a href="/sub6/5">sub6</a><a href="/sub6/6">sub6</a>',
    '<a href="/item/1">굴삭기 1</a><a href="/item/2">굴삭기 2</a><a href="/item/2#b">굴삭기 2</a>',
    '<form method="post" action="/search">찾기<input type="text" name="stx" value="x"><select name="cate_code"><option value="1">One<option value="2">Two</select><input type="submit"></form>',
    case when page_id % 3 = 0 then '<script>fetch("/api/list?x=1"); go(url: "/more");</script>' else '<script>track(1)</script>' end, '</body></html>') as html
from {pages}"""


#: Sites of two dozen pages each that lead on to each other; the pages that were captured, and the surveys' seeds.
DEALERS_SQL = """
select cast(floor(page_id / 24) as bigint) as site, page_id, concat('http://www.dealer', cast(floor(page_id / 24) as bigint), '.example.com/', case when page_id % 24 = 0 then '' else concat('list/', page_id % 24) end) as url,
  case when page_id % 11 = 4 then '404' else '200' end as status, page_id % 11 <> 4 as ok,
  concat('<title>', case when page_id % 5 = 0 then '고객센터' else '굴삭기' end, ' ', page_id, '</title>', case when page_id % 6 = 1 then concat('총 게시물 ', page_id % 90, ' 건') else '' end,
    '<a href="/list/', (page_id * 3 + 1) % 24, '">매물 보기</a><a href="/list/', (page_id * 5 + 2) % 24, '">회사소개</a><a href="/list/', (page_id * 7 + 3) % 24, '"></a><a href="/list/', (page_id * 7 + 3) % 24, '">goods</a><a href="/l/', page_id % 4, '">중고 장비</a>',
    '<a href="/list/', (page_id + 1) % 24, '">로더</a><a href="/list/', (page_id + 9) % 24, '">used</a><a href="/list/', (page_id + 13) % 24, '">list</a><a href="/list/', (page_id + 17) % 24, '">sale ', page_id, '</a><a href="/list/', (page_id + 5) % 24, '">board</a>',
    case when page_id % 3 = 0 then '<a href="/item/1">굴삭기</a>' else '' end, case when page_id % 4 = 1 then '<a href="/item/2">굴삭기</a><a href="/item/3">굴삭기</a>' else '' end) as html
from {pages} where page_id % 7 <> 3"""
SEEDS_SQL = """
select cast(floor(page_id / 24) as bigint) as seed_no, page_id % 24 as pos, concat('http://dealer', cast(floor(page_id / 24) as bigint), '.example.com/', case when page_id % 24 = 0 then '' when page_id % 24 = 5 then 'none' else concat('list/', page_id % 24) end) as url
from {pages} where page_id % 24 in (0, 5, 7) or (page_id % 24 > 9 and floor(page_id / 24) % 4 = 1)"""


#: List pages of a board: one row of a listing, one pinned, one of the house, a short one; and details for every page.
BOARD_SQL = """
select page_id, concat('http://h', page_id % 5, '.example.com/list.html') as url,
  concat('<html><body><a href="/sub8_1_s.html?cate_code=10', lpad(concat(page_id % 50, ''), 4, '0'), '">굴삭기 ', page_id, '</a><a href="/sub8_1_s.html?cate_code=10', lpad(concat(page_id % 50, ''), 4, '0'), '">again</a><a href="/sub8_1_s.html?cate_code=x1">bad</a><a href="/l?page=', page_id % 3, '">n</a>',
    '<table><tr><th>other</th></tr><tr><td>no</td></tr></table><table><tr><th>번호</th><th>모델명</th><th>등록날짜</th></tr>',
    '<tr><td>1</td><td>x</td><td>판매</td><td>현대</td><td>R', page_id, '</td><td>2015-03</td><td>중고</td><td>서울</td><td>8,500만원</td><td>홍</td><td>2026.05.', lpad(concat(page_id % 28 + 1, ''), 2, '0'), '</td><td>1,234</td><td><a href="sub8_1_vvv.html?pid=', page_id, '&z=1">go</a></td></tr>',
    '<tr><td><img src="btn16.png"></td><td>x</td><td>판매</td><td>현대</td><td>R1</td><td></td><td></td><td></td><td></td><td></td><td></td><td></td><td><a href="sub8_1_vvv.html?pid=78">go</a></td></tr>',
    '<tr><td>2</td><td>x</td><td>판매</td><td>현대</td><td>R2</td><td></td><td></td><td></td><td></td><td>그린중기</td><td></td><td></td><td><a href="sub8_1_vvv.html?pid=79">go</a></td></tr><tr><td>3</td><td>short</td></tr></table>',
    '<table class="shop_table"><tr><td class="al"><strong>Nice ', page_id, '</strong></td><td class="ar">n/a</td><td class="ar">2026.04.', lpad(concat(page_id % 28 + 1, ''), 2, '0'), '</td></tr><tr><th>모델명</th><td>old</td><th>가격</th><td>', page_id % 90 + 1, ',000만원</td></tr><tr><th>모델명</th><td>M', page_id, '</td></tr><tr><th>위치</th><td></td></tr></table>',
    '<div class="product_comment">Line 1<br>Line ', page_id, '</div></body></html>') as html
from {pages}"""
TABLES = ("orders", "customer", "events", "pages")


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in TABLES if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    for n in TABLES:
        sql = sql.replace("{" + n + "}", n)
    return sql


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LISTINGS_SQL)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TASKS_SQL)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TRANSITIONS_SQL).withColumn("at", F.col("at").cast("timestamp"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SHOPS_SQL)


def dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DEALERS_SQL)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SEEDS_SQL)


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, BOARD_SQL)
